"""Tables of the audit engine, as DDL. One row per (audit_id, url) for pages, one per audit_id for the rest."""

from __future__ import annotations

from pyspark.sql import types as T

#: Raised with every change of the signals; scores of different versions are not comparable.
SIGNAL_SCHEMA_VERSION = 15
PILLARS = ("seo", "geo", "gso", "aeo", "aso")

CAPTURE = "audit_id string, url string, final_url string, status_code int, redirects int, html string, rendered_html string"

#: What the extractor derives from a page's HTML.
EXTRACTED = """title string, meta_description string, canonical string, meta_robots string,
open_graph map<string,string>, twitter_card map<string,string>, hreflang map<string,string>,
h1_count int, headings map<string,int>, word_count int, text_ratio double, structured_data_types array<string>,
internal_links int, external_links int, internal_link_targets array<string>,
images_total int, images_with_alt int, svg_total int, svg_accessible int,
tables_count int, definition_lists_count int, question_headings int, lead_paragraph_words int,
has_author boolean, author_has_credentials boolean, has_structured_dates boolean,
main_text_ratio double, entity_count int, external_link_domains array<string>, content_date string, social_platforms array<string>,
aso struct<webmcp:struct<has_register_tool:boolean,has_tool_attributes:boolean,tool_count:int,partial_signals:boolean>,
potential_actions:array<string>,action_schema_types:array<string>,agent_usable_forms:int,
agent_usable_forms_detail:map<string,int>,openapi_links:array<string>>"""

PAGE_SIGNALS = f"audit_id string, url string, status_code int, redirects int, render_mode string, render_source string, raw_word_count int, rendered_word_count int, {EXTRACTED}"

SITE_SIGNALS = "audit_id string, robots_found boolean, crawl_delay double, sitemap_valid boolean, sitemap_url_count int, blocked_agent_bots array<string>, agent_bots_checked int"

EXTERNAL_SIGNALS = """audit_id string, core_web_vitals map<string,double>, lighthouse_performance double, open_page_rank double,
referring_domains int, dataforseo_active boolean, kg_presence boolean,
citation_metrics struct<citation_rate:double,mention_rate:double,citation_confidence:double,share_of_voice:double,knowledge_presence:double,average_position:double>,
aio_metrics struct<presence_rate:double,trigger_rate:double,avg_position:double,query_count:int,provider:string>,
ai_discovery_endpoints map<string,boolean>, nlweb_status string, brand_coherence map<string,double>,
gsc struct<avg_position:double,total_clicks:bigint,total_impressions:bigint,avg_ctr:double,date_range_days:int>"""

CRITERION_RESULT = "audit_id string, key string, pillars array<string>, score double, status string, weight double, evidence_tier string, raw_value string, evidence array<string>"

LLM_RESPONSE = "audit_id string, engine string, model string, prompt_id string, repetition int, response_text string, web_search_enabled boolean, citations array<struct<url:string,domain:string,title:string,position:int>>"

GSC_ROW = "audit_id string, period string, dimension string, key string, clicks bigint, impressions bigint, ctr double, position double"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(" ".join(ddl.split()))
