"""Queries on state logs over the events table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import moves, state
from pageloom.sources.tables import table

ORDER = ["ts", "event_id"]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def upsert_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's settings: the kind of event is the key."""
    return state.upsert_latest(log(spark, sf_dir), ["user_id", "event_type"], ["value"], ORDER)


def get_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's click setting, whether set or not."""
    users = log(spark, sf_dir).select("user_id").distinct().withColumn("event_type", F.lit("click"))
    return state.lookup(upsert_settings(spark, sf_dir), users, ["user_id", "event_type"])


def library_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views star and unstar a user's document, errors and purchases put it in and out of the archive."""
    kind = F.col("event_type")
    flag = F.when(kind.isin("click", "view"), "starred").when(kind.isin("error", "purchase"), "archived")
    rows = log(spark, sf_dir).withColumn("flag", flag).filter("flag is not null")
    return rows.select(F.concat(F.lit("/docs/"), "user_id").alias("path"), F.concat(F.lit("n"), "event_id").alias("name"), "flag", kind.isin("click", "error").alias("on"), "ts", F.col("event_id").alias("seq"))


def library_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.library_state(library_log(spark, sf_dir))


def starred_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.flagged(library_state(spark, sf_dir), "starred").select("path", "name", "added_at")


def archived_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.flagged(library_state(spark, sf_dir), "archived").select("path", "name", "added_at")


def get_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's entry, null where the library has none."""
    wanted = table(spark, sf_dir, "customer").select(F.concat(F.lit("/docs/"), "c_custkey").alias("path"))
    return state.lookup(library_state(spark, sf_dir), wanted, ["path"])


def recent_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library entries that are not archived."""
    entries = library_state(spark, sf_dir)
    return entries.join(entries.filter("archived").select("path"), "path", "left_anti").select("path", "starred")


def tab_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a saved session of its customer, its lines the tabs; returned lines are marked active."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("save_no"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("save_no"), F.col("l_linenumber").alias("position")).agg(F.min(F.concat(F.lit("/p/"), "l_partkey")).alias("path"), F.max(F.col("l_returnflag") == "R").alias("is_active"))
    return orders.join(lines, "save_no")


def tab_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.tab_session(tab_log(spark, sf_dir))


def tab_ui_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page and zoom of every customer's view, with the defaults where there was none."""
    seen = log(spark, sf_dir).filter("event_type = 'view'")
    views = seen.select(F.col("user_id").alias("path"), "ts", "event_id", (F.col("event_id") % 50 + 1).alias("current_page"), (F.col("event_id") % 8 / 4 + 0.25).alias("zoom"))
    latest = state.upsert_latest(views, ["path"], ["current_page", "zoom"], ORDER)
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    return state.lookup(latest, wanted, ["path"], {"current_page": 1, "zoom": 1.0})


def cleared_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabs left per customer when every session saved last with three tabs or fewer is cleared."""
    tabs = tab_session(spark, sf_dir)
    small = tabs.groupBy("session").count().filter("count <= 3").select("session")
    return tabs.join(small, "session", "left_anti").groupBy("session").agg(F.count("*").alias("tabs"))


def recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = log(spark, sf_dir).withColumn("item", F.concat("event_type", F.lit("-"), (F.col("event_id") % 20).cast("string")))
    return state.recent(items, ["user_id"], "item", ORDER, 12)


def recent_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.recent(log(spark, sf_dir), ["user_id"], "event_type", ORDER, 3)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "error", "has").otherwise("set")
    return log(spark, sf_dir).select("user_id", "ts", "event_id", F.concat(F.lit("k"), (F.col("event_id") % 9).cast("string")).alias("key"), op.alias("op"))


def _listed(states: DataFrame) -> DataFrame:
    return states.select("user_id", F.array_join("keys", ",").alias("keys"))


def lru_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(state.lru_state(_keyed(spark, sf_dir), ["user_id"], ORDER, "key", "op", 4))


def lru_set_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without gets an LRU cache holds the last distinct keys set: a window over last uses, no fold."""
    last = state.recent(_keyed(spark, sf_dir).filter("op = 'set'"), ["user_id"], "key", ORDER, 4)
    oldest_first = F.reverse(F.array_sort(F.collect_list(F.struct("rank", "key"))))
    return _listed(last.groupBy("user_id").agg(F.transform(oldest_first, lambda x: x["key"]).alias("keys")))


def fifo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(state.fifo_state(_keyed(spark, sf_dir), ["user_id"], ORDER, "key", 4))


def closed_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    tabs = _keyed(spark, sf_dir).withColumn("op", F.when(F.col("op") == "set", "close").otherwise("reopen"))
    return _listed(state.closed_stack(tabs, ["user_id"], ORDER, "key", "op", 3))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors take a user's entry out, all other events put one in."""
    op = F.when(F.col("event_type") == "error", "remove").otherwise("put")
    rows = log(spark, sf_dir).select(F.concat("event_type", F.lit(":"), (F.col("user_id") % 97).cast("string")).alias("key"), op.alias("op"), F.col("event_id").cast("string").alias("value"), "ts", "event_id")
    rows = rows.withColumn("key", F.regexp_replace("key", "^error", "view"))
    return state.cache_entries(rows, ["key"], ORDER)


def evict_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.evict_prefix(cache_entries(spark, sf_dir), "key", "view:")


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.cache_stats(cache_entries(spark, sf_dir), "value")


def newest_thumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thumbnails keyed by user and kind; those of older versions (days) go."""
    rows = log(spark, sf_dir).withColumn("version", F.date_trunc("day", "ts"))
    return state.newest_versions(rows.select("user_id", "event_type", "version", "event_id"), ["user_id", "event_type"], "version")


def stale_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen within a day before the log's last event."""
    rows = log(spark, sf_dir)
    now = rows.agg(F.max("ts")).scalar()
    return state.fresh(rows.groupBy("user_id").agg(F.max("ts").alias("seen")), "seen", now, 86_400)


def batch_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' files on the list, then customers' ones that are not yet."""
    name = lambda k: F.concat(F.lit("/f/"), F.col(k).cast("string")).alias("path")
    present = table(spark, sf_dir, "supplier").select(name("s_suppkey"), F.lit("old").alias("status"))
    new = table(spark, sf_dir, "customer").select(name("c_custkey"), F.lit("new").alias("status"))
    return state.add_absent(present, new, ["path"])


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "queued").otherwise("done")
    return state.batch_report(log(spark, sf_dir).select(kind.alias("status")))


def tab_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's tabs with the first one moved to the third place."""
    tabs = tab_session(spark, sf_dir).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("position", "path"))).alias("tabs"))
    paths = F.transform("tabs", lambda t: t["path"])
    return tabs.select("session", F.array_join(state.moved(paths, F.lit(0), F.lit(2)), ",").alias("paths"))


def move_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events move twelve tabs about, some of them out of range; the fourth tab is active."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    users = events.select("user_id").distinct()
    tabs = users.select("user_id", F.posexplode(F.array(*[F.lit(f"tab {i}") for i in range(12)])).alias("place", "tab"))
    steps = events.select("user_id", "event_id", (F.col("event_id") * 7 % 13).cast("int").alias("source"), (F.col("event_id") * 5 % 12).cast("int").alias("target"))
    return moves.final_order(tabs, steps, users.select("user_id", F.lit(3).alias("place")), ["user_id"], ["event_id"], "tab")


def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A free name for a copy of each brand's file, where the brand's first parts took some."""
    parts = table(spark, sf_dir, "part")
    stem = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")
    taken = parts.select(F.when(F.col("p_size") % 5 == 0, stem).otherwise(F.concat(stem, F.lit("-"), (F.col("p_size") % 5).cast("string"))).alias("name")).filter(F.col("p_size") < 30).distinct()
    return state.free_suffix(parts.select(stem.alias("name")), taken)


QUERIES = {f.__name__: f for f in (upsert_settings, get_setting, library_state, starred_list, archived_list, get_entry, recent_visible, tab_session, tab_ui_state, cleared_sessions, recent_topk, recent_signatures, lru_state, lru_set_only, fifo_state, closed_stack, cache_entries, evict_prefix, cache_stats, newest_thumbs, stale_ttl, batch_add, batch_report, tab_moves, free_names, move_log)}

SETTINGS = "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL"
LIBRARY = """
SELECT path, arg_max(name, at) AS name, coalesce(arg_max("on", at) FILTER (WHERE flag = 'starred'), false) AS starred,
       coalesce(arg_max("on", at) FILTER (WHERE flag = 'archived'), false) AS archived, arg_min(ts, at) AS added_at
FROM (SELECT '/docs/' || user_id AS path, 'n' || event_id AS name, ts, (ts, event_id) AS at, event_type IN ('click', 'error') AS "on",
             CASE WHEN event_type IN ('click', 'view') THEN 'starred' ELSE 'archived' END AS flag
      FROM events WHERE event_type IN ('click', 'view', 'error', 'purchase')) l
GROUP BY path""".replace("at)", "moment)").replace(" AS at,", " AS moment,")
TABS = """
SELECT session, position, path, position = coalesce(max(position) FILTER (WHERE is_active) OVER (PARTITION BY session), 0) AS active
FROM (SELECT o_custkey AS session, max(o_orderkey) AS save_no FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1) s
JOIN (SELECT l_orderkey AS save_no, l_linenumber AS position, min('/p/' || l_partkey) AS path, bool_or(l_returnflag = 'R') AS is_active FROM lineitem GROUP BY 1, 2) t USING (save_no)"""
KEYED = "SELECT user_id, ts, event_id, 'k' || event_id % 9 AS key, CASE event_type WHEN 'view' THEN 'get' WHEN 'error' THEN 'has' ELSE 'set' END AS op FROM events"


def _fold(rows: str, cap: int, step: str) -> str:
    """A recursive walk over each user's numbered events, the state a list."""
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ({rows}) r),
    f AS (SELECT user_id, 0::BIGINT AS n, []::VARCHAR[] AS s FROM e GROUP BY user_id
          UNION ALL SELECT f.user_id, e.n, {step} FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, array_to_string(arg_max(s, n), ',') AS keys FROM f GROUP BY user_id"""


TOUCH = "list_append(list_filter(s, lambda x: x <> key), key)"
LRU = f"CASE WHEN op = 'set' OR (op = 'get' AND list_contains(s, key)) THEN {TOUCH}[-4:] ELSE s END"
ENTRIES = """SELECT key, value FROM (SELECT replace(event_type, 'error', 'view') || ':' || user_id % 97 AS key, arg_max(event_id::VARCHAR, (ts, event_id)) AS value,
  arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) WHERE last <> 'error'"""
ORACLES = {
    "upsert_settings": SETTINGS,
    "get_setting": f"SELECT user_id, 'click' AS event_type, value FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN ({SETTINGS} HAVING event_type = 'click') s USING (user_id)",
    "library_state": LIBRARY,
    "starred_list": f"SELECT path, name, added_at FROM ({LIBRARY}) WHERE starred",
    "archived_list": f"SELECT path, name, added_at FROM ({LIBRARY}) WHERE archived",
    "get_entry": f"SELECT w.path, name, starred, archived, added_at FROM (SELECT '/docs/' || c_custkey AS path FROM customer) w LEFT JOIN ({LIBRARY}) l USING (path)",
    "recent_visible": f"SELECT path, starred FROM ({LIBRARY}) WHERE NOT archived",
    "tab_session": TABS,
    "tab_ui_state": "SELECT c_custkey AS path, coalesce(arg_max(event_id % 50 + 1, (ts, event_id)), 1) AS current_page, coalesce(arg_max(event_id % 8 / 4 + 0.25::DOUBLE, (ts, event_id)), 1.0::DOUBLE) AS zoom FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'view' GROUP BY c_custkey",
    "cleared_sessions": f"SELECT session, count(*) AS tabs FROM ({TABS}) GROUP BY session HAVING count(*) > 3",
    "recent_topk": "SELECT user_id, CAST(rank AS INTEGER) AS rank, item FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY max((ts, event_id)) DESC, item) AS rank FROM (SELECT *, event_type || '-' || event_id % 20 AS item FROM events) GROUP BY user_id, item) WHERE rank <= 12",
    "recent_signatures": "SELECT user_id, CAST(rank AS INTEGER) AS rank, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max((ts, event_id)) DESC, event_type) AS rank FROM events GROUP BY user_id, event_type) WHERE rank <= 3",
    "lru_state": _fold(KEYED, 4, LRU),
    "lru_set_only": f"SELECT user_id, string_agg(key, ',' ORDER BY last) AS keys FROM (SELECT user_id, key, max((ts, event_id)) AS last, row_number() OVER (PARTITION BY user_id ORDER BY max((ts, event_id)) DESC) AS rank FROM ({KEYED}) WHERE op = 'set' GROUP BY user_id, key) WHERE rank <= 4 GROUP BY user_id",
    "fifo_state": _fold(KEYED, 4, "CASE WHEN list_contains(s, key) THEN s ELSE list_append(s, key)[-4:] END"),
    "closed_stack": _fold(KEYED, 3, f"CASE WHEN op = 'set' THEN {TOUCH}[-3:] WHEN len(s) > 0 THEN s[:len(s) - 1] ELSE s END"),
    "cache_entries": ENTRIES,
    "evict_prefix": f"SELECT * FROM ({ENTRIES}) WHERE NOT starts_with(key, 'view:')",
    "cache_stats": f"SELECT count(*) AS entries, CAST(coalesce(sum(strlen(value)), 0) AS BIGINT) AS bytes FROM ({ENTRIES})",
    "newest_thumbs": "SELECT user_id, event_type, version, event_id FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP AS version, max(date_trunc('day', ts)) OVER (PARTITION BY user_id, event_type) AS newest FROM events) WHERE version = newest",
    "stale_ttl": "SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id HAVING epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', max(ts))) <= 86400",
    "batch_add": "SELECT '/f/' || s_suppkey AS path, 'old' AS status FROM supplier UNION ALL SELECT '/f/' || c_custkey, 'new' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "batch_report": "SELECT count(*) FILTER (WHERE event_type NOT IN ('error', 'purchase')) AS done, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS total FROM events",
    "tab_moves": f"SELECT session, array_to_string(CASE WHEN len(p) > 2 THEN list_concat(p[2:3], [p[1]], p[4:]) ELSE p END, ',') AS paths FROM (SELECT session, list(path ORDER BY position) AS p FROM ({TABS}) GROUP BY session)",
    "move_log": """WITH RECURSIVE m AS (SELECT user_id, event_id * 7 % 13 AS s, event_id * 5 % 12 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
      w AS (SELECT user_id, 0::BIGINT AS n, range(0, 12) AS items FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT user_id, n, CASE WHEN s > 11 THEN items ELSE list_concat(rest[1:t], [items[s + 1]], rest[t + 1:]) END FROM (SELECT w.user_id, m.n, m.s, m.t, w.items, list_concat(w.items[1:m.s], w.items[m.s + 2:]) AS rest FROM w JOIN m ON m.user_id = w.user_id AND m.n = w.n + 1)),
      l AS (SELECT user_id, arg_max(items, n) AS items FROM w GROUP BY user_id)
      SELECT user_id, CAST(place AS INTEGER) AS place, 'tab ' || items[place + 1] AS tab, items[place + 1] = 3 AS active FROM (SELECT user_id, items, unnest(range(0, 12)) AS place FROM l)""",
    "free_names": """WITH t AS (SELECT DISTINCT regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || CASE WHEN p_size % 5 = 0 THEN '' ELSE '-' || p_size % 5 END AS name FROM part WHERE p_size < 30),
      n AS (SELECT DISTINCT regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS name FROM part),
      c AS (SELECT name, i, CASE WHEN i = 0 THEN name ELSE name || '-' || i END AS option FROM n, range(0, 50) r(i))
      SELECT name, arg_min(option, i) AS free FROM c WHERE option NOT IN (SELECT name FROM t) GROUP BY name""",
}
