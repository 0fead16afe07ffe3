"""Lookups, visibility, pages, joins, statistics and table changes on the driver's tables.

Documents and conversations stand for transcripts, events for timed facts and entries (their
type is the scope), documents and labels for sentences and recordings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import maintenance as m
from ..operators import relational as r
from ..operators import snapshots as sn
from ..operators import symbols as sy
from ..session import shared_folder
from .registry import query
from .tables import table

SPACES = "length(text) - length(replace(text, ' ', '')) + 1"


def as_of():
    return F.lit("2024-01-31").cast("timestamp")


@query("tenant_stats", f"SELECT source, count(*) AS total, CAST(sum({SPACES}) AS BIGINT) AS total_words, round(avg(n_chars), 2) AS avg_duration FROM documents GROUP BY source")
def tenant_stats(spark, sf):
    return r.usage(table(spark, sf, "documents"), ["source"], duration="n_chars")


@query("tenant_dashboard", f"""
WITH t AS (SELECT * FROM documents WHERE source = 'src1'),
m AS (SELECT mode, coalesce(n, 0) AS n FROM (VALUES ('en'), ('fr'), ('tr')) AS a(mode) FULL JOIN (SELECT lang AS mode, count(*) AS n FROM t GROUP BY lang) b USING (mode))
SELECT (SELECT count(*) FROM t) AS total, (SELECT CAST(sum({SPACES}) AS BIGINT) FROM t) AS total_words,
       (SELECT string_agg(mode || '=' || n, ',' ORDER BY mode) FROM m) AS modes, (SELECT count(*) FROM customer WHERE c_nationkey = 1) AS total_users""")
def tenant_dashboard(spark, sf):
    docs = r.matching(table(spark, sf, "documents"), source="src1")
    figures = r.usage(docs, duration="n_chars").select("total", "total_words")
    modes = r.mode_breakdown(docs, ("en", "fr", "tr"), "lang")
    text = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "mode", F.col("n").cast("string")))), ",")
    users = r.matching(table(spark, sf, "customer"), c_nationkey=1).agg(F.count("*").alias("total_users"))
    return figures.crossJoin(modes.agg(text.alias("modes"))).crossJoin(users)


@query("words_by_mode", f"SELECT role, count(*) AS total, CAST(sum({SPACES}) AS BIGINT) AS total_words, round(avg(turn), 2) AS avg_duration FROM conversations GROUP BY role")
def words_by_mode(spark, sf):
    return r.usage(table(spark, sf, "conversations"), ["role"], duration="turn")


@query("mode_breakdown_dense", """
SELECT mode, coalesce(n, 0) AS n FROM (VALUES ('user'), ('assistant'), ('system'), ('tool')) AS a(mode)
LEFT JOIN (SELECT coalesce(role, 'user') AS mode, count(*) AS n FROM conversations GROUP BY 1) b USING (mode)""")
def mode_breakdown_dense(spark, sf):
    return r.mode_breakdown(table(spark, sf, "conversations"), ("user", "assistant", "system", "tool"), "role")


@query("active_users_7d", "SELECT count(DISTINCT user_id) AS active_users FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def active_users_7d(spark, sf):
    return r.active_users(table(spark, sf, "events"), as_of(), at="ts")


@query("active_users_each_day", """
WITH d AS (SELECT DISTINCT user_id % 3 AS tenant_id, CAST(ts AS DATE) AS day, user_id FROM events WHERE user_id IS NOT NULL),
w AS (SELECT DISTINCT tenant_id, CAST(day + CAST(i AS INTEGER) AS DATE) AS day, user_id FROM d, range(0, 7) r(i))
SELECT tenant_id, CAST(day AS VARCHAR) AS day, count(*) AS active_users FROM w WHERE day <= (SELECT max(day) FROM d) GROUP BY tenant_id, day""")
def active_users_each_day(spark, sf):
    rows = table(spark, sf, "events").withColumn("tenant_id", F.col("user_id") % 3)
    return r.active_users_each_day(rows, user="user_id", at="ts").withColumn("day", F.col("day").cast("string"))


@query("trailing_phrases", r"""
WITH k AS (SELECT conv_id % 11 AS tenant_id, lower(text) AS t, row_number() OVER (PARTITION BY conv_id % 11 ORDER BY conv_id DESC, turn DESC) AS k FROM conversations WHERE text IS NOT NULL),
l AS (SELECT tenant_id, k, list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '') AS w FROM k WHERE k <= 200), e AS (SELECT *, w[greatest(1, len(w) - 4):] AS e FROM l),
g AS (SELECT DISTINCT tenant_id, k, array_to_string(e[i:i + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(e) - n + 2)) AS i FROM e, range(2, 6) r(n)) WHERE len(e) >= n)
SELECT tenant_id, phrase, count(*) AS n, round(count(*) / (SELECT count(*) FROM l WHERE l.tenant_id = g.tenant_id), 6) AS share FROM g GROUP BY tenant_id, phrase
HAVING count(*) >= 0.15 * (SELECT count(*) FROM l WHERE l.tenant_id = g.tenant_id)""")
def trailing_phrases(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("tenant_id", F.col("conv_id") % 11)
    return r.trailing_phrases(rows, "tenant_id", [F.desc("conv_id"), F.desc("turn")]).withColumn("share", F.round("share", 6))


EVENT = ("event_id", "user_id", "event_type")


@query("history_page", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 20")
def history_page(spark, sf):
    rows = r.matching(table(spark, sf, "events"), event_type="view", user_id=None)
    return r.page(rows, [F.desc("ts"), F.desc("event_id")], 100, 20).select(*EVENT)


@query("member_history", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 100")
def member_history(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("tenant_id"), "user_id", F.col("ts").alias("created_at"))
    return r.history(rows, "click", "member", 7).select(F.col("id").alias("event_id"), "user_id", F.col("tenant_id").alias("event_type"))


@query("audit_page", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_page(spark, sf):
    return r.page(table(spark, sf, "events"), [F.desc("ts"), F.desc("event_id")], 200).select(*EVENT)


@query("point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf):
    return r.point(table(spark, sf, "customer"), c_custkey=42).select("c_custkey", "c_name")


def entries(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("scope"), F.col("props").alias("trigger"))


@query("visible_entries_pipeline", "SELECT event_id, user_id, event_type AS scope, props AS trigger FROM events WHERE event_type IN ('signup', 'purchase') OR user_id = 7")
def visible_entries_pipeline(spark, sf):
    return r.visible_in_pipeline(entries(spark, sf), 7, ("signup", "purchase"))


@query("visible_entries_ui", "SELECT event_id, user_id, event_type AS scope, props AS trigger FROM events WHERE event_type = 'signup' OR (user_id = 7 AND event_type = 'click')")
def visible_entries_ui(spark, sf):
    named = entries(spark, sf).replace({"signup": "team", "click": "personal"}, subset=["scope"])
    return r.visible_to_user(named, 7).replace({"team": "signup", "personal": "click"}, subset=["scope"])


@query("search_history", "SELECT conv_id, turn, contains(text, '_') AND contains(text, '%') AS wild FROM conversations WHERE contains(lower(text), 'the')")
def search_history(spark, sf):
    found = r.search(table(spark, sf, "conversations"), F.col("text"), "THE").select("conv_id", "turn", "text")
    wild = r.search(r.search(found, F.col("text"), "%"), F.col("text"), "_").select("conv_id", "turn", F.lit(True).alias("wild"))
    return found.join(wild, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("wild", F.lit(False)).alias("wild"))


def sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels")


@query("recorded_docs", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def recorded_docs(spark, sf):
    return r.recorded(*sentences(spark, sf), "doc_id", "doc_id")


@query("unrecorded_docs", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unrecorded_docs(spark, sf):
    return r.unrecorded(*sentences(spark, sf), "doc_id", "doc_id")


@query("take_counts", "SELECT doc_id, lang, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS take_count FROM documents d")
def take_counts(spark, sf):
    return r.take_counts(*sentences(spark, sf), "doc_id", "doc_id")


@query("recordings_nested", "SELECT n.n_name, string_agg(s.s_name, ',' ORDER BY s.s_suppkey) AS names FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name")
def recordings_nested(spark, sf):
    nested = r.with_recordings(table(spark, sf, "nation"), table(spark, sf, "supplier"), ["s_suppkey", "s_name"], "n_nationkey", "s_nationkey")
    return nested.select("n_name", F.array_join(F.transform("recordings", lambda x: x["s_name"]), ",").alias("names"))


@query("pick_unrecorded", """
SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l USING (doc_id) ORDER BY coalesce(n, 0) > 0, md5('5:' || d.doc_id), d.doc_id LIMIT 1""")
def pick_unrecorded(spark, sf):
    return r.pick_unrecorded(*sentences(spark, sf), 5, "doc_id", "doc_id").select("doc_id")


@query("lookup_ladder", """
WITH n AS (SELECT DISTINCT p_name FROM part),
h AS (SELECT p_name, CASE WHEN lower(p_name) = 'b' THEN 0 WHEN starts_with(lower(p_name), 'b') THEN 1 ELSE 2 END AS tier FROM n WHERE contains(lower(p_name), 'b'))
SELECT p_name, tier FROM h WHERE tier = (SELECT min(tier) FROM h) ORDER BY length(p_name), p_name LIMIT 5""")
def lookup_ladder(spark, sf):
    return sy.lookup(table(spark, sf, "part").select("p_name").distinct(), "B", 5, "p_name", None)


@query("lookup_by_kind", """
WITH p AS (SELECT DISTINCT CASE p_partkey % 2 WHEN 0 THEN p_name ELSE upper(p_name) END AS symbol_name, CASE p_size % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'func' WHEN 2 THEN 'struct' ELSE 'protocol' END AS symbol_type FROM part)
SELECT *, 0 AS tier FROM p WHERE lower(symbol_name) = (SELECT min(p_name) FROM part)
ORDER BY CASE symbol_type WHEN 'class' THEN 0 WHEN 'struct' THEN 1 WHEN 'protocol' THEN 2 ELSE 3 END, symbol_name LIMIT 5""")
def lookup_by_kind(spark, sf):
    part = table(spark, sf, "part")
    kinds = F.element_at(F.array(*map(F.lit, ("class", "func", "struct", "protocol"))), F.col("p_size") % 4 + 1)
    symbols = part.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("symbol_name"), kinds.alias("symbol_type")).distinct()
    return sy.lookup(symbols, part.agg(F.min("p_name")).first()[0])


def indexed(spark, sf):
    return table(spark, sf, "events").select("user_id", F.col("event_type").alias("project_path"), F.col("ts").alias("indexed_at"))


@query("projects_count", "SELECT event_type AS project_path, count(*) AS symbols FROM events WHERE user_id = 7 GROUP BY ROLLUP (event_type)")
def projects_count(spark, sf):
    return r.projects(indexed(spark, sf), 7)


@query("context_status", "SELECT count(*) AS symbols, max(ts) AS last_indexed FROM events WHERE user_id = 7")
def context_status(spark, sf):
    return r.context_status(indexed(spark, sf), 7)


@query("stale_projects", """
SELECT event_type AS project_path, CAST(floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(max(ts))) AS BIGINT) AS age FROM events WHERE user_id = 7
GROUP BY event_type HAVING floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(max(ts))) > 86400""")
def stale_projects(spark, sf):
    return sy.stale(indexed(spark, sf), 7, as_of(), 86400)


@query("running_best", """
WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, min(value) AS loss FROM events GROUP BY 1)
SELECT day, loss, min(loss) OVER w AS best, coalesce(loss < min(loss) OVER p, true) AS improved FROM d
WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING), p AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_best(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.min("value").alias("loss"))
    return r.running_best(days, "day", "loss").drop("improvement_pct")


@query("symbol_by_name", """
SELECT lower(event_type) AS name, event_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(event_type) ORDER BY CASE WHEN user_id % 3 = 0 THEN 0 WHEN user_id % 3 = 1 THEN 1 ELSE 2 END, event_id) AS n FROM events) WHERE n = 1""")
def symbol_by_name(spark, sf):
    kind = F.element_at(F.array(F.lit("class"), F.lit("struct"), F.lit("enum")), (F.col("user_id") % 3 + 1).cast("int"))
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol_name"), kind.alias("symbol_type"))
    return sy.by_name(rows).select(F.lower("symbol_name").alias("name"), F.col("id").alias("event_id"))


@query("upsert_latest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark, sf):
    return m.latest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("upsert_config", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation")
def upsert_config(spark, sf):
    nation = table(spark, sf, "nation")
    new = nation.where("n_regionkey = 1").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))
    return m.upsert(nation, new, ["n_nationkey"])


@query("retention_purge", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def retention_purge(spark, sf):
    return m.purge(table(spark, sf, "events"), "ts", F.lit("2024-01-15").cast("timestamp")).select("event_id")


@query("delete_own_entries", "SELECT event_id FROM events WHERE NOT (event_type = 'click' AND user_id = 7)")
def delete_own_entries(spark, sf):
    return m.delete(table(spark, sf, "events"), (F.col("event_type") == "click") & (F.col("user_id") == 7)).select("event_id")


@query("update_role", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'admin' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_role(spark, sf):
    return m.update(table(spark, sf, "customer"), F.col("c_nationkey") == 3, c_mktsegment=F.lit("admin")).select("c_custkey", "c_mktsegment")


@query("erasure_marks", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE user_id % 10 <> 7 GROUP BY event_type")
def erasure_marks(spark, sf):
    """A tenth of the users erased by their keys alone: the events' files stay as they are, and readers leave the rows out."""
    root = f"{shared_folder(spark)}/erasure-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    sn.change(spark, root, {"events": events})
    sn.change(spark, root, erase={"events": events.where("user_id % 10 = 7").select("user_id").distinct()})
    return sn.read(spark, root, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("erasure_counts", """
SELECT count(*) FILTER (event_type = 'view') AS transcriptions, count(*) FILTER (event_type = 'click') AS user_dictionary,
       count(*) FILTER (event_type = 'purchase') AS snippets, count(*) FILTER (event_type = 'error') AS correction_feedback
FROM events WHERE user_id = 7""")
def erasure_counts(spark, sf):
    rows = table(spark, sf, "events").withColumn("tenant_id", F.lit("default"))
    kinds = dict(zip(m.ERASED, ("view", "click", "purchase", "error")))
    return m.erase_user({n: rows.where(F.col("event_type") == k) for n, k in kinds.items()}, "default", 7)[1]


@query("replace_scope", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 100 + r_regionkey, r_name FROM region")
def replace_scope(spark, sf):
    new = table(spark, sf, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return m.replace_scope(table(spark, sf, "nation"), new, F.col("n_regionkey") == 2).select("n_nationkey", "n_name")


@query("import_once", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 200, r_name FROM region")
def import_once(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    new = lambda by: region.select((F.col("r_regionkey") + by).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    once = m.import_once(nation, new(100), F.col("n_regionkey") == 1)  # there are such rows: nothing happens
    return m.import_once(once, new(200), F.col("n_regionkey") == 99).select("n_nationkey", "n_name")


@query("add_missing_entries", "SELECT n_name FROM nation UNION SELECT r_name FROM region")
def add_missing_entries(spark, sf):
    return m.add_missing(table(spark, sf, "nation").select("n_name"), table(spark, sf, "region").select(F.col("r_name").alias("n_name")), ["n_name"])


@query("feedback_errors", """
SELECT CASE WHEN event_type NOT IN ('signup', 'purchase', 'error') THEN 'unknown action' END AS error, count(*) AS n FROM events GROUP BY 1""")
def feedback_errors(spark, sf):
    names = {"signup": "approved", "purchase": "edited", "error": "dismissed"}
    rows = table(spark, sf, "events").replace(names, subset=["event_type"])
    rows = rows.select(F.col("props").alias("raw_whisper"), F.col("props").alias("model_output"), F.col("event_type").alias("user_action"))
    return r.feedback(rows).groupBy("error").agg(F.count("*").alias("n"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("json_round_trip", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS props FROM events")
def json_round_trip(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_json(F.from_json("props", "k long")).alias("props"))
