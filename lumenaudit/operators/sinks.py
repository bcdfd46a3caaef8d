"""Tables, documents and files that come out of an audit."""

from __future__ import annotations

import html
import json
from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import dropped, written
from . import commits
from .rules import catalog
from .scoring import issues, pillar_scores, report

C = F.col
#: Rows of narrow tables (some ten bytes each) that are broadcast at most.
BROADCAST_ROWS = 1_000_000
# Extension of an artifact by type.
EXTENSIONS = {"html_raw": "html.gz", "html_rendered": "html.gz", "report_json": "json", "report_markdown": "md", "report_html": "html", "report_pdf": "pdf", "screenshot": "png"}
REPORT_TABLES = ("audits", "results", "pillars", "issues", "readiness", "signals")
CSV_COLUMNS = ("url", "http", "render", "words", "js_delta", "alt_missing", "alt_total", "svg_unnamed", "svg_total", "forms_usable", "forms_total")


def digest(value: object) -> str:
    """First sixteen hex digits of the SHA-256 of JSON with sorted keys."""
    return sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]


def measurement_profile(tool_version: str, weights: dict, thresholds: dict, overrides: dict, connectors: list[str], schema_version: int) -> dict:
    """What two audits must share to be comparable, with its digest. Drivers compute it; it holds for a whole run."""
    rules = [(r.key, r.weight, list(r.pillars), r.tier) for r in catalog(thresholds)]
    fields = {"tool_version": tool_version, "signal_schema_version": schema_version, "rule_catalog_digest": digest(rules), "pillar_weights": weights, "thresholds": thresholds, "criteria_overrides": overrides, "active_connectors": sorted(connectors)}
    return fields | {"digest": digest(fields)}


def active_connectors() -> Column:
    """Which services answered, from the columns of the external signals."""
    asked = {"psi": C("core_web_vitals").isNotNull() | C("lighthouse_performance").isNotNull(), "opr": C("open_page_rank").isNotNull(), "wikidata": C("kg_presence").isNotNull(), "gsc": C("gsc").isNotNull(), "serp": C("aio_metrics").isNotNull(), "citations": C("citation_metrics").isNotNull()}
    return F.array_sort(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in asked.items())), lambda x: x.isNotNull()))


def object_key(project: Column, run: Column, kind: Column, digest: Column) -> Column:
    """Content-addressed key from the content's SHA-256, null where project or run isn't a plain path segment."""
    plain = lambda c: (F.trim(c) != "") & ~c.rlike(r"[/\\]|\.\.")
    ext = F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), kind)
    return F.when(plain(project) & plain(run), F.concat_ws("/", F.lit("projects"), F.trim(project), F.lit("runs"), F.trim(run), kind, F.concat(digest, F.lit("."), ext)))


def _keyed(contents: DataFrame) -> DataFrame:
    hashed = contents.withColumn("sha256", F.sha2(C("content").cast("binary"), 256))
    return hashed.withColumn("object_key", object_key(C("project_id"), C("run_id"), C("type"), C("sha256"))).where("object_key is not null")


def artifacts(contents: DataFrame) -> DataFrame:
    """contents(project_id, run_id, type, content) to one row per key; equal contents are one artifact. Contents are
    hashed where they are read; only keys, digests and sizes are grouped."""
    return _keyed(contents).select("object_key", "type", "sha256", F.octet_length("content").cast("bigint").alias("bytes")).groupBy("object_key").agg(F.first("type").alias("type"), F.first("sha256").alias("sha256"), F.first("bytes").alias("bytes"))


def _bucket(digest: Column) -> Column:
    return F.concat(F.lit("b"), F.substr(digest, F.lit(1), F.lit(2)))  # never read as a number


def _small(df: DataFrame, most: int) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most so many."""
    return F.broadcast(df) if df.count() <= most else df


def put_artifacts(contents: DataFrame, path: str, most: int = BROADCAST_ROWS) -> int:
    """Stores contents(project_id, run_id, type, content) under their keys; how many keys are new.

    Two tables in 256 buckets by digest: keys, and bodies, each content once. Only digests and keys are grouped and
    compared with what is there. Then the contents are read once more, of which only the rows chosen go on: up to `most`
    chosen rows are broadcast and no body is shuffled; beyond that the join shuffles them. Bodies are written before
    keys, so a key that is there has its body. contents must give the same rows each time they are read, as files do.
    """
    spark = contents.sparkSession
    keyed = _keyed(contents).withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", _bucket(C("sha256")))
    asked = keyed.groupBy("object_key").agg(F.min(F.struct("row", "sha256", "bucket", F.trim("project_id").alias("project_id"), F.trim("run_id").alias("run_id"), "type", F.octet_length(C("content").cast("binary")).cast("bigint").alias("bytes"))).alias("r")).select("object_key", "r.*")
    first = not _exists(spark, f"{path}/keys")
    fresh = written(asked if first else asked.join(spark.read.parquet(f"{path}/keys").select("object_key"), "object_key", "left_anti"))
    bodies = fresh.groupBy("sha256").agg(F.min("row").alias("row"))
    if not first:
        # Bucket by bucket, digests meet digests.
        bodies = bodies.join(spark.read.parquet(f"{path}/bodies").select("sha256"), "sha256", "left_anti")
    chosen = written(bodies.select("row"))
    found = keyed.select("row", "sha256", "bucket", C("content").cast("binary").alias("content")).join(_small(chosen, most), "row").drop("row")
    found.write.mode("append").partitionBy("bucket").parquet(f"{path}/bodies")
    fresh.drop("row").write.mode("append").partitionBy("bucket").parquet(f"{path}/keys")
    n = fresh.count()
    dropped(fresh, chosen)
    return n


def get_artifacts(spark: SparkSession, path: str, keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(object_key, type, sha256, content) of the keys that are there; a content that doesn't have its digest is an error.

    Only the buckets of the keys asked for are read, and up to `most` keys are broadcast to their bodies.
    """
    known = written(spark.read.parquet(f"{path}/keys").join(keys.select("object_key").distinct(), "object_key", "left_semi").select("object_key", "type", "sha256", "bucket"))
    own = [r[0] for r in known.select("bucket").distinct().collect()]  # 256 at most
    bodies = spark.read.schema("sha256 string, content binary, bucket string").parquet(f"{path}/bodies").where(C("bucket").isin(own)).select("sha256", "content")
    fine = F.when(F.sha2("content", 256) == C("sha256"), C("content")).otherwise(F.raise_error(F.concat(F.lit("content and digest differ: "), "object_key")))
    return bodies.join(_small(known.drop("bucket"), most), "sha256").select("object_key", "type", "sha256", fine.alias("content"))


def artifacts_exist(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """keys(object_key) with `exists`; bodies aren't read."""
    there = spark.read.parquet(f"{path}/keys").select("object_key", F.lit(True).alias("exists"))
    return keys.join(there, "object_key", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def save_report(tables: dict[str, DataFrame], path: str, run: str) -> int:
    """Saves a run's tables (audits, results, pillars, issues, readiness, signals), all audits of the run together, below the path.

    Saving a run again replaces what it saved, so a rerun doubles nothing. Pages are saved with all their columns, so
    that they can be scored again. All tables count at once or none: they are written to a folder of their own, and then
    one manifest names them (`commits.commit`). Returns the number of that manifest.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = commits.staged(path)
    for name, df in tables.items():
        df.withColumn("run", F.lit(run)).write.parquet(f"{folder}/{name}")
    return commits.commit(spark, path, {run: {name: f"{folder}/{name}" for name in tables}})


def load_tables(spark: SparkSession, path: str, audits: DataFrame | None = None, version: int | None = None) -> dict[str, DataFrame]:
    """What `save_report` saved, of all audits or of those of audits(audit_id); of an audit that several runs have the last, by the run's name.

    All tables are those of one manifest, the last or that of a version, whatever is saved meanwhile.
    """
    runs = commits.state(spark, path, version)
    places = {n: sorted(t[n] for t in runs.values() if n in t) for n in REPORT_TABLES}
    every = {n: spark.read.option("mergeSchema", True).parquet(*p) for n, p in places.items() if p}
    last = every["audits"].groupBy("audit_id").agg(F.max("run").alias("run"))
    last = last if audits is None else last.join(audits.select("audit_id").distinct(), "audit_id", "left_semi")
    return {n: df.join(last, ["audit_id", "run"], "left_semi").drop("run") for n, df in every.items()}


def load_report(spark: SparkSession, path: str, audits: DataFrame | None = None) -> DataFrame:
    """(audit_id, document): reports of saved audits as JSON, from the rows as they were saved: scores, pillars, rules by
    key, issues by priority, readiness."""
    t = load_tables(spark, path, audits)
    listed = lambda df, order, *cols: df.groupBy("audit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*cols).alias("x")))), lambda r: r["x"]).alias("rows"))
    parts = {
        "criteria": listed(t["results"], F.struct("key"), "key", "pillars", "score", "status", "weight", "evidence_tier"),
        "pillar_scores": listed(t["pillars"], F.struct("pillar"), "pillar", "score", "coverage", "measured", "excluded", "not_applicable"),
        "issues": listed(t["issues"], F.struct(-C("priority"), "key"), *(c for c in t["issues"].columns if c not in ("audit_id", "rank"))),
    }
    whole = t["audits"]
    for name, rows in parts.items():
        whole = whole.join(rows.withColumnRenamed("rows", name), "audit_id", "left")
    if "readiness" in t:
        whole = whole.join(t["readiness"].select("audit_id", F.struct(*(c for c in t["readiness"].columns if c != "audit_id")).alias("aso_readiness")), "audit_id", "left")
    return whole.select("audit_id", F.to_json(F.struct(*whole.columns)).alias("document"))


def host_id(host: Column) -> Column:
    """A host's id, which is the same wherever and whenever it is made: sixteen hex digits of its digest."""
    return F.substr(F.sha2(F.lower(host).cast("binary"), 256), F.lit(1), F.lit(16))


def new_domains(hosts: DataFrame, known: DataFrame) -> DataFrame:
    """(host, host_id) of hosts that aren't known yet, once each. As ids follow from hosts, two writers agree on them."""
    return hosts.select(F.lower("host").alias("host")).distinct().join(known.select(F.lower("host").alias("host")), "host", "left_anti").withColumn("host_id", host_id(C("host")))


def json_reports(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(audit_id, document): an audit's report as JSON, assembled in the engine; its rules number tens, never pages."""
    rows = results.groupBy("audit_id").agg(F.array_sort(F.collect_list(F.struct("key", "score", "status", "weight", "pillars"))).alias("criteria"))
    plan = issues(results).groupBy("audit_id").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "severity", "priority", "bucket"))).alias("issues"))
    whole = report(results, weights).join(rows, "audit_id").join(plan, "audit_id", "left")
    return whole.select("audit_id", F.to_json(F.struct(*(c for c in whole.columns))).alias("document"))


def _cell(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\|", r"\\|"), r"\s*[\r\n]+\s*", " ")


def markdown_reports(results: DataFrame) -> DataFrame:
    """(audit_id, document): headings and tables of pillars and open issues; cells escape bars and line breaks."""
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *(_cell(C(c)) for c in cells)), F.lit(" |"))
    tables = lambda df, order, *cells: df.select("audit_id", C(order).alias("o"), line(*cells).alias("l")).groupBy("audit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda s: s["l"]), "\n").alias(order))
    pillars = tables(pillar_scores(results), "pillar", "pillar", "score", "coverage", "measured", "excluded")
    plan = tables(issues(results), "rank", "rank", "key", "severity", "priority", "bucket")
    whole = report(results).join(pillars, "audit_id").join(plan, "audit_id", "left")
    text = F.concat(
        F.lit("# Audit of "), _cell(C("audit_id")), F.lit("\n\nScore: "), C("score_global"), F.lit(", coverage "), C("coverage"), F.lit(" ("), C("coverage_label"),
        F.lit(")\n\n## Pillars\n\n| pillar | score | coverage | measured | excluded |\n|---|---|---|---|---|\n"), C("pillar"),
        F.lit("\n\n## Issues\n\n| rank | rule | severity | priority | bucket |\n|---|---|---|---|---|\n"), F.coalesce("rank", F.lit("")), F.lit("\n"),
    )
    return whole.select("audit_id", text.alias("document"))


def html_reports(results: DataFrame) -> DataFrame:
    """(audit_id, document): every audit's report as a page, made in the engine as `html_report` makes one; all values are escaped."""
    escape = lambda c: reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), F.coalesce(c.cast("string"), F.lit("")))
    row = lambda *cells: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), escape(C(c)), F.lit("</td>")) for c in cells), F.lit("</tr>"))
    rows = lambda df, order, *cells: df.select("audit_id", C(order).alias("o"), row(*cells).alias("l")).groupBy("audit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda s: s["l"]), "").alias(order))
    head = lambda *names: "<tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"
    pillars = rows(pillar_scores(results), "pillar", "pillar", "score")
    plan = rows(issues(results), "rank", "rank", "key", "severity", "priority", "bucket")
    whole = report(results).join(pillars, "audit_id").join(plan, "audit_id", "left").withColumn("name", escape(C("audit_id")))
    text = F.concat(
        F.lit('<!doctype html><html lang="en"><meta charset="utf-8"><title>Audit of '), "name", F.lit("</title><h1>Audit of "), "name", F.lit("</h1><p>Score "), C("score_global").cast("string"), F.lit(", coverage "), C("coverage").cast("string"),
        F.lit(f"</p><h2>Pillars</h2><table>{head('pillar', 'score')}"), "pillar", F.lit(f"</table><h2>Issues</h2><table>{head('rank', 'key', 'severity', 'priority', 'bucket')}"), F.coalesce("rank", F.lit("")), F.lit("</table></html>"),
    )
    return whole.select("audit_id", text.alias("document"))


def html_report(document: dict) -> str:
    """A report (the parsed JSON of one audit) as a page; every value is escaped."""
    e = lambda x: html.escape("" if x is None else str(x), quote=True)
    rows = lambda items, *keys: "".join("<tr>" + "".join(f"<td>{e(i.get(k))}</td>" for k in keys) + "</tr>" for i in items)
    head = lambda *keys: "<tr>" + "".join(f"<th>{e(k)}</th>" for k in keys) + "</tr>"
    pillars = [{"pillar": k, "score": v} for k, v in (document.get("pillars") or {}).items()]
    return (
        f'<!doctype html><html lang="en"><meta charset="utf-8"><title>Audit of {e(document.get("audit_id"))}</title>'
        f"<h1>Audit of {e(document.get('audit_id'))}</h1><p>Score {e(document.get('score_global'))}, coverage {e(document.get('coverage'))}</p>"
        f"<h2>Pillars</h2><table>{head('pillar', 'score')}{rows(pillars, 'pillar', 'score')}</table>"
        f"<h2>Issues</h2><table>{head('rank', 'key', 'severity', 'priority', 'bucket')}{rows(document.get('issues') or [], 'rank', 'key', 'severity', 'priority', 'bucket')}</table></html>"
    )


def pdf_report(document: dict, width: int = 92, height: int = 58) -> bytes:
    """A report (the parsed JSON of one audit) as a PDF of plain text pages, width characters by height lines.

    Characters beyond Windows-1252 become question marks; parentheses and backslashes are escaped.
    """
    cell = lambda x: "" if x is None else str(x)
    lines = [f"Audit of {cell(document.get('audit_id'))}", "", f"Score {cell(document.get('score_global'))}, coverage {cell(document.get('coverage'))}", "", "Pillars"]
    lines += [f"  {k:<6}{cell(v):>8}" for k, v in sorted((document.get("pillars") or {}).items())]
    lines += ["", "Issues"] + [f"  {cell(i.get('rank')):>3}  {cell(i.get('key')):<28}{cell(i.get('severity')):<10}{cell(i.get('priority')):>6}  {cell(i.get('bucket'))}" for i in document.get("issues") or []]
    lines = [part for line in lines for part in ([line[k : k + width] for k in range(0, len(line), width)] or [""])]
    pages = [lines[k : k + height] for k in range(0, len(lines), height)]
    quoted = lambda t: t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252", "replace")
    # Objects: catalog, page tree, font, then a page and its content for each page.
    kids = b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    for k, page in enumerate(pages):
        text = b"BT /F1 9 Tf 12 TL 48 780 Td " + b" ".join(b"(%s) Tj T*" % quoted(t) for t in page) + b" ET"
        objects += [b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * k), b"<< /Length %d >>\nstream\n%s\nendstream" % (len(text), text)]
    out, at = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n \n" % x for x in at)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, table, len(at) + 1, len(out))


def page_view(signals: DataFrame) -> DataFrame:
    """The page table of the dashboard: derived counts are null where a part is."""
    forms = F.try_element_at(C("aso.agent_usable_forms_detail"), F.lit("found"))
    return signals.select(
        "audit_id", "url", C("status_code").alias("http"), C("render_mode").alias("render"), C("word_count").alias("words"), (C("rendered_word_count") - C("raw_word_count")).alias("js_delta"),
        (C("images_total") - C("images_with_alt")).alias("alt_missing"), C("images_total").alias("alt_total"), (C("svg_total") - C("svg_accessible")).alias("svg_unnamed"), "svg_total",
        C("aso.agent_usable_forms").alias("forms_usable"), forms.alias("forms_total"),
    )


def write_csv(view: DataFrame, path: str) -> None:
    """All cells quoted, nulls empty. Spreadsheets take the first column's byte order mark as UTF-8."""
    cells = [F.coalesce(C(c).cast("string"), F.lit("")).alias(("\ufeff" if c == CSV_COLUMNS[0] else "") + c) for c in CSV_COLUMNS]
    view.select(*cells).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def affected_pages(listed: DataFrame, deltas: DataFrame) -> DataFrame:
    """Pages of an issue with the words that scripts add, where known. listed(audit_id, key, urls)."""
    each = listed.select("audit_id", "key", F.explode("urls").alias("url"))
    return each.join(deltas.select("audit_id", "url", "raw_words", "rendered_words", "delta"), ["audit_id", "url"], "left")
