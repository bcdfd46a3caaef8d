"""Pages of markup made from the part table, so that what the extractor should find is arithmetic on a part's key.

The driver's pages have a title, a heading, links and text, and nothing else; here a part is a page of one of 13 shops
and has, by its key, the elements that signals are read from. Spark makes the HTML; inputs_sql.py has the signals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Over k (a part's key) and s (its shop): pieces of the page in order.
HEAD = (
    "'<html><head><title>Part ' || k || ' &amp; more</title>'",
    "CASE WHEN k % 2 = 0 THEN '<meta name=\"Description\" content=\"About part ' || k || '\">' ELSE '' END",
    "CASE WHEN k % 3 = 0 THEN '<meta name=\"robots\" content=\"noindex, follow\">' ELSE '' END",
    "CASE WHEN k % 4 = 1 THEN '<link rel=\"canonical\" href=\"https://shop' || s || '.example/p/' || k || '\">' ELSE '' END",
    "CASE WHEN k % 4 >= 1 THEN '<meta property=\"og:title\" content=\"T' || k || '\">' ELSE '' END",
    "CASE WHEN k % 4 >= 2 THEN '<meta property=\"og:type\" content=\"product\">' ELSE '' END",
    "CASE WHEN k % 4 >= 3 THEN '<meta property=\"og:image\" content=\"/i.png\">' ELSE '' END",
    "CASE WHEN k % 3 >= 1 THEN '<meta name=\"twitter:card\" content=\"summary\">' ELSE '' END",
    "CASE WHEN k % 3 >= 2 THEN '<meta name=\"twitter:title\" content=\"T\">' ELSE '' END",
    "CASE WHEN k % 5 = 0 THEN '<link rel=\"alternate\" hreflang=\"en\" href=\"/en/' || k || '\"><link rel=\"alternate\" hreflang=\"x-default\" href=\"/' || k || '\">' ELSE '' END",
    "CASE k % 6 WHEN 0 THEN '<script type=\"application/ld+json\">{\"@type\": \"Product\", \"name\": \"P\"}</script>'"
    " WHEN 1 THEN '<script type=\"application/ld+json\">{\"@graph\": [{\"@type\": [\"Article\", \"TechArticle\"], \"author\": {\"@type\": \"Person\", \"name\": \"A\", \"jobTitle\": \"Editor\"}, \"datePublished\": \"2026-01-0' || (1 + k % 9) || '\"}]}</script>'"
    " WHEN 2 THEN '<script type=\"application/ld+json\">{\"@type\": </script>'"
    " WHEN 3 THEN '<script type=\"application/ld+json\">{\"@type\": \"Organization\", \"author\": \"B\", \"sameAs\": [\"https://github.com/x\"], \"potentialAction\": {\"@type\": \"SearchAction\"}}</script>' ELSE '' END",
    "CASE WHEN k % 9 = 0 THEN '<script>navigator.modelContext.registerTool({})</script>' ELSE '' END",
    "'</head><body><nav>menu one two</nav>'",
)
BODY = (
    "CASE WHEN k % 11 = 0 THEN '<div id=\"root\"></div>' ELSE '' END",
    "'<main>' || repeat('<h1>Part ' || k || '</h1>', CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END)",
    "repeat('<h2>What is it?</h2>', CAST(k % 3 AS INT))",
    "CASE WHEN k % 2 = 1 THEN '<h4>Notes</h4>' ELSE '' END",
    "'<p>' || repeat('word ', CAST(k % 12 AS INT)) || '</p>'",
    "repeat('<img src=\"a.png\" alt=\"A\">', CAST(least(k % 5, k % 3) AS INT)) || repeat('<img src=\"b.png\" alt=\" \">', CAST(k % 5 - least(k % 5, k % 3) AS INT))",
    "repeat('<div><svg aria-label=\"i\"></svg></div>', CAST(least(k % 4, k % 2) AS INT)) || repeat('<div><svg></svg></div>', CAST(k % 4 - least(k % 4, k % 2) AS INT))",
    "CASE WHEN k % 3 = 2 THEN '<table><tr><td>cell</td></tr></table>' ELSE '' END",
    "CASE WHEN k % 4 = 3 THEN '<dl><dt>a</dt><dd>b</dd></dl>' ELSE '' END",
    "CASE k % 5 WHEN 1 THEN '<form action=\"/s\"><label>q</label><input name=\"q\"></form>' WHEN 2 THEN '<form><input name=\"q\"></form>' WHEN 3 THEN '<form method=\"get\"></form>' WHEN 4 THEN '<form action=\"/x\"><input name=\"z\"></form>' ELSE '' END",
    "CASE WHEN k % 8 = 0 THEN '<div toolname=\"t\"></div>' ELSE '' END",
    "CASE WHEN k % 6 >= 1 THEN '<a href=\"/l1#top\">go</a>' ELSE '' END || CASE WHEN k % 6 >= 2 THEN '<a href=\"/l2\">go</a><a href=\"/l2\">again</a>' ELSE '' END",
    "CASE WHEN k % 3 >= 1 THEN '<a href=\"https://out1.example/x\">out</a>' ELSE '' END || CASE WHEN k % 3 >= 2 THEN '<a href=\"https://out2.example/\">out</a><a href=\"mailto:a@b.example\">mail</a>' ELSE '' END",
    "CASE WHEN k % 10 = 0 THEN '<a href=\"/OpenAPI.json\">api</a>' ELSE '' END",
    "'</main></body></html>'",
)

#: Pages that a task parses at most, about.
PAGES = 10_000


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table is one row group; its keys are spread before pages are made of them, to tasks that don't grow with the table.
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tasks = max(spark.sparkContext.defaultParallelism, -(-part.count() // PAGES))
    keys = part.selectExpr("p_partkey AS k", "p_partkey % 13 AS s").repartition(tasks)
    html = " || ".join(f"({p})" for p in (*HEAD, *BODY))
    return keys.selectExpr("'shop' || s || '.example' AS audit_id", "'https://shop' || s || '.example/p/' || k AS url", "'https://shop' || s || '.example/p/' || k AS final_url", "200 AS status_code", "0 AS redirects", f"{html} AS html", "CAST(NULL AS STRING) AS rendered_html")
