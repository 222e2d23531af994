"""The registered queries of the profiling operators, each with the same statement in DuckDB's SQL."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.context import POSITION
from stratalens.context import positioned as source_positioned
from stratalens.functions import blocks
from stratalens.functions.counts import GroupCounts, dependency_measures, distinct_groups, group_sizes, impurity, modal, numbered
from stratalens.functions.values import display, quoted
from stratalens.operators import availability as av
from stratalens.operators import census as ce
from stratalens.operators import dependencies as de
from stratalens.operators import grain as gr
from stratalens.operators import levels as le
from stratalens.operators import pairs as pa
from stratalens.operators import paths as pt
from stratalens.operators import patterns as vp
from stratalens.operators import relate as re_
from stratalens.sources.tables import normalise, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Line items with their order, customer, nation and region: the chain region, nation, customer, order."""
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "o_custkey", "o_orderstatus", "o_orderpriority", "c_nationkey", "c_mktsegment", "n_regionkey", "n_name")


SALES_COLUMNS = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "o_custkey", "o_orderstatus", "o_orderpriority", "c_nationkey", "c_mktsegment", "n_regionkey", "n_name"]
SALES = """sales AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, o_custkey, o_orderstatus, o_orderpriority, c_nationkey, c_mktsegment, n_regionkey, n_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels, of which most have none; the extra column is missing where the label is 1."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    l = labels.select(F.col("doc_id").alias("lid"), "quality", "toxic")
    j = docs.select("doc_id", "lang", "source", "n_chars").join(l, F.col("doc_id") == F.col("lid"), "left").drop("lid")
    return j.withColumn("calm", F.when(F.col("toxic") == 0, 1)).withColumn("bad", F.when(F.col("quality") == 0, 1))


LABELLED = """lab AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic, CASE WHEN toxic = 0 THEN 1 END AS calm, CASE WHEN quality = 0 THEN 1 END AS bad
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
MARKED = ["quality", "toxic", "calm", "bad"]


def positioned(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(POSITION, quoted(column).cast("bigint"))


def shown(t: DataFrame) -> DataFrame:
    return t.select("feature", "rank", display(F.col("value")).alias("value"), F.col("n").alias("cnt"))


# ---- levels -------------------------------------------------------------------------------------------------


def _levels_sql(source: str, cols: list[str], where: str = "", most: int | None = None, least: int = 1) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, {c} ASC NULLS LAST) AS rank FROM {source} {where.format(c=c)} GROUP BY {c}" for c in cols)
    return f"SELECT feature, CAST(rank AS INTEGER) AS rank, value, cnt FROM ({parts}) WHERE cnt >= {least}" + (f" AND rank <= {most}" if most else "")


@query(_levels_sql("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]))
def levels_rank(spark, d):
    frame, kinds = normalise(table(spark, d, "lineitem"))
    return shown(le.level_table(frame, kinds, ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"], max_levels=None))


@query(_levels_sql("lineitem", ["l_partkey", "l_suppkey"], least=40))
def levels_min_count(spark, d):
    frame, kinds = normalise(table(spark, d, "lineitem"))
    return shown(le.level_table(frame, kinds, ["l_partkey", "l_suppkey"], min_count=40, max_levels=None))


@query(_levels_sql("(SELECT nullif(o_orderstatus, 'P') AS o_orderstatus, o_orderpriority FROM orders)", ["o_orderstatus", "o_orderpriority"]))
def levels_sentinel(spark, d):
    frame, kinds = normalise(table(spark, d, "orders"), {"o_orderstatus": ["P"]})
    return shown(le.level_table(frame, kinds, ["o_orderstatus", "o_orderpriority"]))


@query(f"WITH {LABELLED} " + _levels_sql("lab", ["quality", "toxic", "lang"], "WHERE {c} IS NOT NULL", most=3))
def levels_dropna(spark, d):
    frame, kinds = normalise(labelled(spark, d))
    return shown(le.level_table(frame, kinds, ["quality", "toxic", "lang"], dropna=True, top_n=3))


# ---- census -------------------------------------------------------------------------------------------------


def _tree(frame, dims, **options):
    _, nodes = ce.tree_table(frame, dims, **options)
    path = F.array_join(F.transform("path", lambda x: F.coalesce(x["text"], F.lit("∅"))), "/")
    return nodes.select("number", "depth", path.alias("path"), F.col("n").alias("cnt"))


def _tree_sql(with_: str, source: str, a: str, b: str, keep_a: str = "true", keep_b: str = "true", most: int = 10000) -> str:
    return f"""WITH {with_} base AS (SELECT {a} AS a, {b} AS b FROM {source}),
la AS (SELECT a, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, a NULLS LAST) AS r FROM base GROUP BY a),
lb AS (SELECT a, b, count(*) AS n, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, b NULLS LAST) AS r FROM base GROUP BY a, b),
tb AS (SELECT b, row_number() OVER (ORDER BY count(*) DESC, b NULLS LAST) AS g FROM base GROUP BY b),
ka AS (SELECT * FROM la WHERE {keep_a}),
kb AS (SELECT lb.*, ka.r AS ra, lb.r AS rb FROM lb JOIN ka ON lb.a IS NOT DISTINCT FROM ka.a JOIN tb ON lb.b IS NOT DISTINCT FROM tb.b WHERE {keep_b}),
every AS (SELECT 1 AS depth, r AS ra, 0 AS rb, coalesce(CAST(a AS VARCHAR), '∅') AS path, n AS cnt FROM ka
  UNION ALL SELECT 2, ra, rb, coalesce(CAST(a AS VARCHAR), '∅') || '/' || coalesce(CAST(b AS VARCHAR), '∅'), n FROM kb),
numbered AS (SELECT CAST(row_number() OVER (ORDER BY depth, ra, rb) - 1 AS INTEGER) AS number, depth, path, cnt FROM every)
SELECT number, depth, path, cnt FROM numbered WHERE number < {most}"""


@query(_tree_sql(SALES + ",", "sales", "n_regionkey", "c_nationkey"))
def census_rollup(spark, d):
    return _tree(normalise(sales(spark, d))[0], ["n_regionkey", "c_nationkey"])


@query(_tree_sql(SALES + ",", "sales", "c_mktsegment", "n_name", "r <= 3", "tb.g <= 3"))
def census_top_n_post(spark, d):
    return _tree(normalise(sales(spark, d))[0], ["c_mktsegment", "n_name"], top_n=3)


@query(_tree_sql(SALES + ",", "sales", "c_mktsegment", "n_name", "r <= 3", "lb.r <= 3"))
def census_per_parent(spark, d):
    return _tree(normalise(sales(spark, d))[0], ["c_mktsegment", "n_name"], top_n=3, per_parent=True)


@query(_tree_sql(f"{SALES}, ps AS (SELECT c_mktsegment FROM sales GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2), pn AS (SELECT n_name FROM sales GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4), cohort AS (SELECT * FROM sales WHERE c_mktsegment IN (FROM ps) AND n_name IN (FROM pn)),", "cohort", "c_mktsegment", "n_name"))
def census_top_n_pre(spark, d):
    rows = normalise(sales(spark, d))[0]
    # 2 segments and 4 nations: each column's top levels, then the rows that have both
    for c, n in (("c_mktsegment", ce.top_values(rows, "c_mktsegment", 2)), ("n_name", ce.top_values(rows, "n_name", 4))):
        rows = ce._semi(rows, n, [c])
    return _tree(rows, ["c_mktsegment", "n_name"])


@query(_tree_sql(SALES + ",", "sales", "o_orderpriority", "o_custkey", "true", "lb.n >= 2 AND lb.r <= 20", most=60))
def census_max_nodes(spark, d):
    return _tree(normalise(sales(spark, d))[0], ["o_orderpriority", "o_custkey"], max_levels=20, min_count=2, max_nodes=60)


# ---- grain --------------------------------------------------------------------------------------------------

MEASURES = ["evaluated_groups", "violating_groups", "affected_rows", "evaluated_rows", "singleton_groups", "repeated_groups"]


def _groups_sql(source: str, keys: str, target: str, where: str = "true") -> str:
    """One dependency test: groups with their size, largest value count and distinct values."""
    return f"""(SELECT count(*) AS evaluated_groups, CAST(coalesce(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS violating_groups,
  CAST(coalesce(sum(CASE WHEN k > 1 THEN sz ELSE 0 END), 0) AS BIGINT) AS affected_rows, CAST(coalesce(sum(sz), 0) AS BIGINT) AS evaluated_rows,
  CAST(coalesce(sum(CASE WHEN sz = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS singleton_groups, CAST(coalesce(sum(CASE WHEN sz > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS repeated_groups,
  CAST(coalesce(sum(CASE WHEN sz > 1 THEN sz ELSE 0 END), 0) AS BIGINT) AS repeated_rows, CAST(coalesce(sum(sz - mx), 0) AS BIGINT) AS repair_rows
  FROM (SELECT CAST(sum(n) AS BIGINT) AS sz, max(n) AS mx, count(*) AS k FROM (SELECT {keys}, {target} AS t, count(*) AS n FROM {source} WHERE {where} GROUP BY ALL) GROUP BY {keys}))"""


KEYS = {"region": ("n_regionkey",), "nation": ("c_nationkey",), "customer": ("o_custkey",), "order": ("l_orderkey",), "line": ("l_orderkey", "l_linenumber")}
TARGETS = ["n_name", "c_mktsegment", "o_orderstatus", "l_returnflag"]


def _grain_sql() -> str:
    parts = [f"SELECT '{k}' AS key_name, '{t}' AS feature, {', '.join(MEASURES)} FROM {_groups_sql('sales', ', '.join(cols), t)}" for k, cols in KEYS.items() for t in TARGETS]
    return f"WITH {SALES} " + " UNION ALL ".join(parts)


@query(_grain_sql())
def grain_tests(spark, d):
    frame, kinds = normalise(sales(spark, d))
    return gr.grain_tests(frame, kinds, [gr.KeySpec(k, c) for k, c in KEYS.items()], TARGETS).select("key_name", "feature", *MEASURES)


@query(
    f"WITH {SALES}, c AS (SELECT "
    + ", ".join(f"count(DISTINCT ({', '.join(cols)},)) AS n{i}" if len(cols) == 1 else f"count(DISTINCT ({', '.join(cols)})) AS n{i}" for i, cols in enumerate(KEYS.values()))
    + ", "
    + ", ".join(f"count(DISTINCT ({', '.join(dict.fromkeys([*a, *b]))},)) AS p{i}_{j}" if len({*a, *b}) == 1 else f"count(DISTINCT ({', '.join(dict.fromkeys([*a, *b]))})) AS p{i}_{j}" for i, a in enumerate(KEYS.values()) for j, b in enumerate(KEYS.values()) if i != j)
    + " FROM sales) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, n{i} = p{i}_{j} AS a_determines_b FROM c" for i, a in enumerate(KEYS) for j, b in enumerate(KEYS) if i != j)
)
def grain_relationships(spark, d):
    frame, _ = normalise(sales(spark, d))
    names = list(KEYS)
    counts = GroupCounts(frame, frame.count(), frame.columns).ask([{*KEYS[a], *KEYS[b]} for a in names for b in names])
    rows = [(a, b, gr.finer(counts, KEYS[a], KEYS[b])) for a in names for b in names if a != b]
    return spark.createDataFrame(rows, "a string, b string, a_determines_b boolean")


def _placement_sql() -> str:
    """Keys that determine each other are one node; edges without shortcuts; each other column at its coarsest nodes."""
    groups = lambda *cols: f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(dict.fromkeys(cols))} FROM sales))"
    det = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {groups(*a)} = {groups(*a, *b)} AS fixes" for i, a in enumerate(KEYS.values()) for j, b in enumerate(KEYS.values()))
    inside = {c for cols in KEYS.values() for c in cols}
    others = [c for c in SALES_COLUMNS if c not in inside]
    fits = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS col, {groups(*a)} = {groups(*a, c)} AS holds" for i, a in enumerate(KEYS.values()) for c in others)
    return f"""WITH {SALES}, name AS (SELECT unnest({list(KEYS)}) AS name, unnest(range({len(KEYS)})) AS i), det AS ({det}),
home AS (SELECT a.i, min(a.j) AS node FROM det a JOIN det b ON a.i = b.j AND a.j = b.i WHERE a.fixes AND b.fixes GROUP BY a.i),
node AS (SELECT node, string_agg(name, '+' ORDER BY name.i) AS label FROM home JOIN name ON home.i = name.i GROUP BY node),
below AS (SELECT det.j AS coarse, det.i AS fine FROM det JOIN node a ON a.node = det.i JOIN node b ON b.node = det.j WHERE fixes AND det.i <> det.j),
edge AS (SELECT * FROM below x WHERE NOT EXISTS (SELECT 1 FROM below y JOIN below z ON y.fine = z.coarse WHERE y.coarse = x.coarse AND z.fine = x.fine)),
fits AS ({fits}), homes AS (SELECT DISTINCT col, node FROM fits JOIN home ON fits.i = home.i WHERE holds),
coarsest AS (SELECT * FROM homes h WHERE NOT EXISTS (SELECT 1 FROM homes o JOIN below ON o.node = coarse AND h.node = fine WHERE o.col = h.col))
SELECT 'edge' AS what, a.label AS a, b.label AS b FROM edge JOIN node a ON a.node = coarse JOIN node b ON b.node = fine
UNION ALL SELECT 'column', col, string_agg(label, ',' ORDER BY coarsest.node) FROM coarsest JOIN node ON coarsest.node = node.node GROUP BY col
UNION ALL SELECT DISTINCT 'unplaced', col, 'no_supported_key' FROM fits WHERE col NOT IN (SELECT col FROM homes)"""


@query(_placement_sql())
def grain_placement(spark, d):
    found = gr.grain(sales(spark, d), KEYS, identify=False)["graph"]
    node = {n["id"]: "+".join(n["keys"]) for n in found["nodes"]}
    rows = [("edge", node[e["source"]], node[e["target"]]) for e in found["edges"]]
    rows += [("column", a["target"], ",".join(node[n] for n in a["nodes"])) for a in found["assignments"]]
    rows += [("unplaced", u["target"], u["reason"]) for u in found["unplaced"]]
    return spark.createDataFrame(rows, "what string, a string, b string")


def _targets_sql() -> str:
    """For each target the keys that fix it, and of these the coarsest: those that fix no other one that does not fix them too."""
    groups = lambda *cols: f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(dict.fromkeys(cols))} FROM sales))"
    det = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {groups(*a)} = {groups(*a, *b)} AS fixes" for i, a in enumerate(KEYS.values()) for j, b in enumerate(KEYS.values()))
    fits = " UNION ALL ".join(f"SELECT {i} AS i, '{t}' AS target, {groups(*a)} = {groups(*a, t)} AS holds" for i, a in enumerate(KEYS.values()) for t in TARGETS)
    return f"""WITH {SALES}, name AS (SELECT unnest({list(KEYS)}) AS name, unnest(range({len(KEYS)})) AS i), det AS ({det}), fits AS ({fits}), held AS (SELECT i, target FROM fits WHERE holds),
coarsest AS (SELECT * FROM held a WHERE NOT EXISTS (SELECT 1 FROM held b JOIN det f ON f.i = a.i AND f.j = b.i JOIN det g ON g.i = b.i AND g.j = a.i WHERE b.target = a.target AND f.fixes AND NOT g.fixes))
SELECT target, string_agg(name, ',' ORDER BY held.i) AS determining, (SELECT string_agg(n.name, ',' ORDER BY c.i) FROM coarsest c JOIN name n ON n.i = c.i WHERE c.target = held.target) AS coarsest
FROM held JOIN name ON name.i = held.i GROUP BY target"""


@query(_targets_sql())
def grain_targets(spark, d):
    found = gr.grain(sales(spark, d), KEYS, features=TARGETS, identify=False)["targets"]
    rows = [(t["target"], ",".join(t["determining_keys"]), ",".join(t["coarsest_candidates"])) for t in found if t["determining_keys"]]
    return spark.createDataFrame(rows, "target string, determining string, coarsest string")


# ---- positions and scopes -----------------------------------------------------------------------------------


@query("SELECT l_returnflag, min(p) AS first, max(p) AS last, count(DISTINCT p) AS positions FROM (SELECT *, row_number() OVER () - 1 AS p FROM lineitem) GROUP BY l_returnflag")
def source_positions(spark, d):
    rows = source_positioned(table(spark, d, "lineitem"))
    return rows.groupBy("l_returnflag").agg(F.min(POSITION).alias("first"), F.max(POSITION).alias("last"), F.count_distinct(POSITION).alias("positions"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS cnt, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE l_linenumber = 1 OR l_returnflag = 'R' GROUP BY 1, 2")
def scope_blocks(spark, d):
    """The rows of a scope by the blocks that it is saved as."""
    rows = source_positioned(table(spark, d, "lineitem"))
    chosen = blocks.compressed(rows.where("l_linenumber = 1 or l_returnflag = 'R'").select(POSITION), POSITION)
    return blocks.within(rows, chosen, POSITION).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("cnt"), F.sum("l_orderkey").alias("keys"))


# ---- pairs --------------------------------------------------------------------------------------------------


def _relation_sql(with_: str, source: str, a: str, b: str, where: str = "true") -> str:
    return f"""{with_} p AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {source} WHERE {where} GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, count(*) OVER (PARTITION BY a) AS fa, count(*) OVER (PARTITION BY b) AS fb FROM p),
s AS (SELECT CAST(sum(n) AS BIGINT) AS evaluated, count(*) AS cells, count(DISTINCT (a,)) AS la, count(DISTINCT (b,)) AS lb, max(fa) AS fa, max(fb) AS fb, sum(CAST(n AS DOUBLE) * n / (CAST(na AS DOUBLE) * nb)) AS term FROM w)
SELECT evaluated AS rows, cells, la AS levels_a, lb AS levels_b, CASE WHEN fa > 1 AND fb > 1 THEN 'n:m' WHEN fa > 1 THEN '1:n' WHEN fb > 1 THEN 'n:1' ELSE '1:1' END AS relation,
round(least(1.0, sqrt(greatest(0.0, evaluated * term - evaluated) / (evaluated * (least(la, lb) - 1)))), 6) AS cramers_v FROM s"""


def _relation(cells):
    return pa.relation_table(cells).withColumn("cramers_v", F.round("cramers_v", 6) + F.lit(0.0))


@query(_relation_sql("WITH", "lineitem", "l_returnflag", "l_linestatus"))
def pairs_relation(spark, d):
    return _relation(le.pair_table(normalise(table(spark, d, "lineitem"))[0], "l_returnflag", "l_linestatus"))


@query(_relation_sql("WITH", "customer", "c_mktsegment", "c_nationkey"))
def pairs_cramers_v(spark, d):
    return _relation(le.pair_table(normalise(table(spark, d, "customer"))[0], "c_mktsegment", "c_nationkey"))


@query(_relation_sql(f"WITH {SALES},", "sales", "o_orderpriority", "n_regionkey", "o_orderstatus = 'F'"))
def pairs_context(spark, d):
    return _relation(le.pair_table(normalise(sales(spark, d))[0], "o_orderpriority", "n_regionkey", context={"o_orderstatus": "F"}))


@query("""WITH p AS (SELECT DISTINCT c_mktsegment AS a, c_nationkey AS b FROM customer),
da AS (SELECT unnest(['BUILDING', 'MACHINERY', 'NOWHERE']) AS a), db AS (SELECT unnest(range(0, 27)) AS b)
SELECT da.a, CAST(db.b AS INTEGER) AS b, CASE WHEN da.a IN (SELECT a FROM p) AND db.b IN (SELECT b FROM p) THEN 'within_observed_margins' ELSE 'zero_support' END AS reason
FROM da, db WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.a = da.a AND p.b = db.b)""")
def pairs_absence(spark, d):
    frame, _ = normalise(table(spark, d, "customer"))
    cells = le.pair_table(frame, "c_mktsegment", "c_nationkey")
    a = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("NOWHERE",)], "a string")
    return pa.absent_table(cells, a, spark.range(27).select(F.col("id").cast("int").alias("b")))


@query("""WITH w AS (SELECT DISTINCT c_mktsegment AS a, c_nationkey AS b FROM customer), p AS (SELECT DISTINCT c_mktsegment AS a, c_nationkey AS b FROM customer WHERE c_nationkey = 3),
da AS (SELECT unnest(['BUILDING', 'MACHINERY', 'NOWHERE']) AS a), db AS (SELECT unnest(range(0, 27)) AS b)
SELECT da.a, CAST(db.b AS INTEGER) AS b, CASE WHEN da.a IN (SELECT a FROM p) AND db.b IN (SELECT b FROM p) THEN 'within_observed_margins' WHEN da.a IN (SELECT a FROM w) AND db.b IN (SELECT b FROM w) THEN 'level_absent_under_parent' ELSE 'zero_support' END AS reason
FROM da, db WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.a = da.a AND p.b = db.b)""")
def pairs_context_absence(spark, d):
    frame, _ = normalise(table(spark, d, "customer"))
    whole = le.pair_table(frame, "c_mktsegment", "c_nationkey")
    inside = le.pair_table(frame.where("c_nationkey = 3"), "c_mktsegment", "c_nationkey")
    a = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("NOWHERE",)], "a string")
    return pa.absent_table(inside, a, spark.range(27).select(F.col("id").cast("int").alias("b")), whole)


@query("""WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), da AS (SELECT DISTINCT a FROM p), db AS (SELECT DISTINCT b FROM p)
SELECT da.a, db.b, 'within_observed_margins' AS reason FROM da, db WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.a = da.a AND p.b = db.b) ORDER BY 1, 2 LIMIT 1000""")
def pairs_first_absent(spark, d):
    """The first 1000 combinations (the operation's own bound) of parts and suppliers that no line has."""
    cells = le.pair_table(normalise(table(spark, d, "lineitem"))[0], "l_partkey", "l_suppkey")
    return pa.absent_table(cells, cells.select("a"), cells.select("b"), most=pa.LIMITS["max_absence_cells"])


@query("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def joint_counts(spark, d):
    return le.pair_table(normalise(table(spark, d, "lineitem"))[0], "l_returnflag", "l_linestatus")


@query("SELECT l_linenumber AS a, l_returnflag AS b, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2850")
def joint_counts_min_count(spark, d):
    return le.pair_table(normalise(table(spark, d, "lineitem"))[0], "l_linenumber", "l_returnflag").where("n >= 2850")


@query("SELECT l_returnflag AS a, nullif(l_discount, 0) AS b, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2")
def joint_counts_context(spark, d):
    frame, _ = normalise(table(spark, d, "lineitem"), {"l_discount": [0]})
    return le.pair_table(frame, "l_returnflag", "l_discount", context={"l_linestatus": "O"})


def _roles_sql() -> str:
    numbers = {"c_custkey", "c_nationkey", "c_acctbal"}
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS rows, count(DISTINCT ({c},)) AS d, {str(c in numbers).lower()} AS num FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    return f"""SELECT feature, rows, d AS "distinct", CASE WHEN d = rows THEN 'id' WHEN num AND d > least(20.0, rows / 2) THEN 'continuous' WHEN d <= greatest(20, floor(rows * 0.1)) THEN 'categorical' ELSE 'unknown' END AS role,
    lower(feature) LIKE '%id' AS named_id FROM ({parts})"""


@query(_roles_sql())
def schema_roles(spark, d):
    frame, kinds = normalise(table(spark, d, "customer"))
    return le.role_table(frame, kinds, list(kinds))


# ---- availability -------------------------------------------------------------------------------------------

SIG = "concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '0' ELSE '1' END" for c in MARKED) + ")"


def _signatures(spark, d):
    return av.signature_table(positioned(labelled(spark, d), "doc_id"), MARKED)


def _each(cols, text: str, with_: str = f"WITH {LABELLED} ") -> str:
    return with_ + " UNION ALL ".join(text.format(c=c) for c in cols)


@query(_each(MARKED, "SELECT '{c}' AS feature, count({c}) AS populated, count(*) - count({c}) AS missing, count(*) AS denominator FROM lab"))
def availability(spark, d):
    return av.availability_table(_signatures(spark, d), MARKED)


@query(f"WITH {LABELLED} SELECT {SIG} AS signature, count(*) AS n, min(doc_id) AS first FROM lab GROUP BY 1")
def signatures(spark, d):
    return _signatures(spark, d)


@query(f"""WITH {LABELLED}, s AS (SELECT {SIG} AS g, count(*) AS n FROM lab GROUP BY 1),
b AS (SELECT i, list(substring(g, i, 1) ORDER BY g) AS bits, sum(CASE WHEN substring(g, i, 1) = '0' THEN n ELSE 0 END) AS gone FROM s, range(1, 5) t(i) GROUP BY i)
SELECT string_agg({'[' + ', '.join(f"'{c}'" for c in MARKED) + ']'}[i], ',' ORDER BY i) AS members FROM b WHERE gone > 0 GROUP BY bits HAVING count(*) > 1""")
def families(spark, d):
    found = av.family_table(_signatures(spark, d), MARKED)
    return spark.createDataFrame([(",".join(g),) for g in found], "members string")


PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def _pairs_frame(spark, d):
    counted = av.pair_counts(_signatures(spark, d), MARKED, PAIRS)
    rows = [(MARKED[i], MARKED[j], *c) for (i, j), c in zip(PAIRS, counted)]
    return spark.createDataFrame(rows, "a string, b string, together bigint, first bigint, second bigint, neither bigint")


PAIR_SQL = " UNION ALL ".join(f"SELECT '{MARKED[i]}' AS a, '{MARKED[j]}' AS b, count(*) FILTER ({MARKED[i]} IS NOT NULL AND {MARKED[j]} IS NOT NULL) AS together, count(*) FILTER ({MARKED[i]} IS NOT NULL AND {MARKED[j]} IS NULL) AS first, count(*) FILTER ({MARKED[i]} IS NULL AND {MARKED[j]} IS NOT NULL) AS second, count(*) FILTER ({MARKED[i]} IS NULL AND {MARKED[j]} IS NULL) AS neither FROM lab" for i, j in PAIRS)


@query(f"WITH {LABELLED} SELECT *, round(together / nullif(together + first + second, 0), 6) AS jaccard FROM ({PAIR_SQL})")
def presence_pairs(spark, d):
    return _pairs_frame(spark, d).withColumn("jaccard", F.round(F.try_divide(F.col("together"), F.col("together") + F.col("first") + F.col("second")), 6))


@query(f"""WITH {LABELLED}, p AS ({PAIR_SQL}), r AS (SELECT a AS source, b AS target, together, together + first AS n, together + second AS t, together + first + second + neither AS everything, first + second = 0 AS same FROM p
UNION ALL SELECT b, a, together, together + second, together + first, together + first + second + neither, first + second = 0 FROM p)
SELECT source, target, n AS antecedent_populated, round(together / n, 6) AS conditional_presence FROM r WHERE n > 0 AND NOT same AND t < everything AND together / n >= 0.9""")
def implications(spark, d):
    p = _pairs_frame(spark, d)
    everything = F.col("together") + F.col("first") + F.col("second") + F.col("neither")
    one = lambda a, b, n, t: p.select(F.col(a).alias("source"), F.col(b).alias("target"), "together", (F.col("together") + F.col(n)).alias("antecedent_populated"), (F.col("together") + F.col(t)).alias("t"), everything.alias("everything"), (F.col("first") + F.col("second") == 0).alias("same"))
    r = one("a", "b", "first", "second").unionByName(one("b", "a", "second", "first"))
    rate = F.try_divide(F.col("together"), F.col("antecedent_populated"))
    return r.where((F.col("antecedent_populated") > 0) & ~F.col("same") & (F.col("t") < F.col("everything")) & (rate >= 0.9)).select("source", "target", "antecedent_populated", F.round(rate, 6).alias("conditional_presence"))


STATES = {"finished": "F", "opened": "O", "partial": "P"}


@query(
    "WITH o AS (SELECT " + ", ".join(f"CASE WHEN o_orderstatus = '{v}' THEN o_totalprice END AS {k}" for k, v in STATES.items()) + ", o_custkey AS customer FROM orders) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b FROM o HAVING count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) = 0 AND count({a}) > 0 AND count({b}) > 0" for a, b in combinations([*STATES, "customer"], 2))
)
def mutually_exclusive(spark, d):
    orders = table(spark, d, "orders")
    orders = orders.select("o_orderkey", F.col("o_custkey").alias("customer"), *(F.when(F.col("o_orderstatus") == v, F.col("o_totalprice")).alias(k) for k, v in STATES.items()))
    names = [*STATES, "customer"]
    numbers = list(combinations(range(len(names)), 2))
    counted = av.pair_counts(av.signature_table(positioned(normalise(orders)[0], "o_orderkey"), names), names, numbers)
    rows = [(names[i], names[j]) for (i, j), (together, first, second, _) in zip(numbers, counted) if not together and first and second]
    return spark.createDataFrame(rows, "a string, b string")


@query(f"WITH {LABELLED} SELECT a, b, round(together / (together + first + second), 6) AS presence_jaccard FROM ({PAIR_SQL}) WHERE together > 0 AND first + second > 0 AND together / (together + first + second) >= 0.5")
def similar_availability(spark, d):
    share = F.try_divide(F.col("together"), F.col("together") + F.col("first") + F.col("second"))
    return _pairs_frame(spark, d).where((F.col("together") > 0) & (F.col("first") + F.col("second") > 0) & (share >= 0.5)).select("a", "b", F.round(share, 6).alias("presence_jaccard"))


@query(f"WITH {LABELLED} SELECT lang, count(*) AS rows, min(doc_id) AS first, {', '.join(f'count({c}) AS {c}' for c in MARKED)} FROM lab GROUP BY lang")
def availability_by_context(spark, d):
    t = av.context_table(positioned(labelled(spark, d), "doc_id"), MARKED, ["lang"])
    return t.select(F.col("_b0").alias("lang"), "rows", "first", *(F.col(f"_p{i}").alias(c) for i, c in enumerate(MARKED)))


ENTITY = ", ".join(f"count({c}) AS {c}" for c in MARKED)


@query(f"WITH {LABELLED}, e AS (SELECT source, lang, count(*) AS r, {ENTITY} FROM lab GROUP BY 1, 2) " + " UNION ALL ".join(f'SELECT \'{c}\' AS feature, count(*) AS entities, count(*) FILTER ({c} > 0) AS "any", count(*) FILTER ({c} = r) AS "all", count(*) FILTER ({c} = 1) AS one, count(*) FILTER ({c} > 0 AND {c} < r) AS "some", count(*) FILTER ({c} = 0) AS "none" FROM e' for c in MARKED))
def entity_summary(spark, d):
    return av.entity_table(positioned(labelled(spark, d), "doc_id"), MARKED, ["source", "lang"])


def _entity_sql(test: str) -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} {test}) AS populated, count(*) - count(*) FILTER ({c} {test}) AS missing, count(*) AS denominator FROM e" for c in MARKED)
    return f"WITH {LABELLED}, e AS (SELECT source, lang, count(*) AS r, {ENTITY} FROM lab GROUP BY 1, 2) {cells}"


def _entity(spark, d, mode):
    units = av.unit_frame(positioned(labelled(spark, d), "doc_id"), MARKED, ["source", "lang"], mode)
    return av.availability_table(av.signature_table(units, MARKED), MARKED)


@query(_entity_sql("> 0"))
def entity_any(spark, d):
    return _entity(spark, d, "any")


@query(_entity_sql("= r"))
def entity_all(spark, d):
    return _entity(spark, d, "all")


@query(f"WITH {LABELLED} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(count({c}) FILTER (doc_id % 2 = 1) / count(*) FILTER (doc_id % 2 = 1) - count({c}) FILTER (doc_id % 2 = 0) / count(*) FILTER (doc_id % 2 = 0), 6) AS populated_fraction_delta FROM lab" for c in MARKED))
def availability_change(spark, d):
    docs = positioned(labelled(spark, d), "doc_id")
    halves = [av.availability_table(av.signature_table(docs.where(F.col("doc_id") % 2 == i), MARKED), MARKED) for i in range(2)]
    share = lambda t, n: t.select(F.col("feature").alias(n), (F.col("populated") / F.col("denominator")).alias(f"{n}_share"))
    a, b = share(halves[0], "a"), share(halves[1], "b")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("feature"), (F.round(F.col("b_share") - F.col("a_share"), 6) + F.lit(0.0)).alias("populated_fraction_delta"))


# ---- dependencies -------------------------------------------------------------------------------------------

TESTED = ["evaluated_groups", "violating_groups", "affected_rows", "evaluated_rows", "repeated_groups", "repeated_rows", "repair_rows"]


def _tests(frame, kinds, keys, targets, dropna=True):
    parts = [de.test_table(frame, kinds, k, targets, (), dropna).select(F.lit("+".join(k)).alias("determinant"), "feature", *TESTED) for k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tests_sql(with_: str, source: str, keys, targets, dropna=True) -> str:
    parts = []
    for k in keys:
        for t in targets:
            if t not in k:
                where = " AND ".join(f"{c} IS NOT NULL" for c in [*k, t]) if dropna else "true"
                parts.append(f"SELECT '{'+'.join(k)}' AS determinant, '{t}' AS feature, {', '.join(TESTED)} FROM {_groups_sql(source, ', '.join(k), t, where)}")
    return with_ + " UNION ALL ".join(parts)


LINES = [("l_suppkey",), ("l_partkey",), ("l_returnflag",), ("l_orderkey",)]
LINE_TARGETS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]


@query(_tests_sql("", "lineitem", LINES, LINE_TARGETS))
def dependency_tests(spark, d):
    frame, kinds = normalise(table(spark, d, "lineitem"))
    return _tests(frame, kinds, LINES, LINE_TARGETS)


@query(_tests_sql("", "lineitem", [("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey")], ["l_returnflag", "l_linestatus"]))
def dependency_composite(spark, d):
    frame, kinds = normalise(table(spark, d, "lineitem"))
    return _tests(frame, kinds, [("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey")], ["l_returnflag", "l_linestatus"])


@query(_tests_sql(f"WITH {LABELLED} ", "lab", [("source",), ("quality",), ("lang", "toxic")], MARKED, dropna=False))
def dependency_missing_category(spark, d):
    frame, kinds = normalise(labelled(spark, d))
    return _tests(frame, kinds, [("source",), ("quality",), ("lang", "toxic")], MARKED, dropna=False)


@query(f"WITH {SALES} " + " UNION ALL ".join(f"SELECT '{c}' AS determinant, CAST(sum(n) AS BIGINT) AS evaluated_rows, count(*) AS groups, count(*) FILTER (n > 1) AS repeated_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS repeated_rows FROM (SELECT {c}, count(*) AS n FROM sales WHERE {c} IS NOT NULL GROUP BY 1)" for c in ("l_orderkey", "o_custkey", "n_name", "o_orderpriority")))
def dependency_candidates(spark, d):
    frame, _ = normalise(sales(spark, d))
    parts = [de.candidate_table(frame, (c,)).select(F.lit(c).alias("determinant"), "*") for c in ("l_orderkey", "o_custkey", "n_name", "o_orderpriority")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""WITH {SALES}, p AS (SELECT n_regionkey, o_custkey, o_orderstatus AS t, count(*) AS n FROM sales GROUP BY ALL), g AS (SELECT n_regionkey, sum(n) AS sz, max(n) AS mx, count(*) AS k FROM p GROUP BY n_regionkey, o_custkey)
SELECT n_regionkey, count(*) AS evaluated_groups, count(*) FILTER (k > 1) AS violating_groups, CAST(sum(sz - mx) AS BIGINT) AS repair_rows, CAST(sum(sz) AS BIGINT) AS evaluated_rows FROM g GROUP BY n_regionkey""")
def dependency_contexts(spark, d):
    frame, kinds = normalise(sales(spark, d))
    return de.test_table(frame, kinds, ("o_custkey",), ["o_orderstatus"], ["n_regionkey"]).select(F.col("_c0").alias("n_regionkey"), "evaluated_groups", "violating_groups", "repair_rows", "evaluated_rows")


LATTICE = ["n_regionkey", "c_nationkey", "n_name", "c_mktsegment", "o_custkey"]
LATTICE_KEYS = [k for size in (1, 2) for k in combinations(LATTICE, size)]


@query(_tests_sql(f"WITH {SALES} ", "sales", LATTICE_KEYS, LATTICE))
def dependency_lattice(spark, d):
    """All tests of all keys of one and two columns, of which the search counts only what smaller keys leave open."""
    frame, kinds = normalise(sales(spark, d).select(*LATTICE))
    frame = frame.persist()  # as the operation does; gone before this returns
    try:
        lattice = de.Lattice(frame, kinds, frame.count(), LATTICE)
        lattice.measure(LATTICE_KEYS)
        found = lattice.test([(k, [t for t in LATTICE if t not in k]) for k in LATTICE_KEYS])
    finally:
        frame.unpersist()
    names = {frozenset(k): "+".join(k) for k in LATTICE_KEYS}
    rows = [(names[k], t, *(m[x] for x in TESTED)) for (k, t), m in found.items()]
    return spark.createDataFrame(rows, "determinant string, feature string, " + ", ".join(f"{x} bigint" for x in TESTED))


@query("""WITH p AS (SELECT o_custkey AS k, o_orderstatus AS t, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT k, CAST(sum(n) AS BIGINT) AS sz, count(*) AS d FROM p GROUP BY 1 HAVING count(*) > 1),
m AS (SELECT k, t FROM (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY n DESC, t) AS r FROM p) WHERE r = 1)
SELECT o_orderkey, g.sz AS size, g.d AS "distinct" FROM orders o JOIN g ON o.o_custkey = g.k JOIN m ON m.k = g.k WHERE o.o_orderstatus <> m.t""")
def dependency_exceptions(spark, d):
    frame, kinds = normalise(table(spark, d, "orders"))
    rows = de.exception_rows(positioned(frame, "o_orderkey"), kinds, ("o_custkey",), ["o_orderstatus"])
    return rows.where("not good").select(F.col(POSITION).alias("o_orderkey"), "size", "distinct")


NEEDS = [("lang",), ("quality",), ("toxic",), ("calm",), ("bad",), ("quality", "calm"), ("lang", "toxic")]


def _populations_sql() -> str:
    """The rows on which each need is complete, told apart by which columns with gaps are filled on all of them."""
    filled = " || ".join(f"CASE WHEN count({c}) = count(*) THEN '{c} ' ELSE '' END" for c in sorted(MARKED))
    parts = [f"SELECT count(*) AS rows, {filled} AS filled FROM lab WHERE {' AND '.join(f'{c} IS NOT NULL' for c in need)}" for need in NEEDS]
    return f"WITH {LABELLED} SELECT DISTINCT rows, trim(filled) AS filled FROM ({' UNION ALL '.join(parts)}) WHERE rows > 0"


@query(_populations_sql())
def dependency_populations(spark, d):
    frame, _ = normalise(labelled(spark, d))
    found = de.populations(frame, sorted(MARKED), [frozenset(n) & set(MARKED) for n in NEEDS])
    return spark.createDataFrame([(x.rows, " ".join(sorted(x.filled))) for x in found], "rows bigint, filled string")


# ---- paths --------------------------------------------------------------------------------------------------

NESTED = ["n_regionkey", "c_nationkey", "n_name", "c_mktsegment", "o_custkey"]
NESTED_PAIRS = [(a, b) for i, a in enumerate(NESTED) for b in NESTED[i + 1 :]]
NEST_SQL = f"WITH {SALES}, c AS (SELECT " + ", ".join(f"count(DISTINCT ({a},)) AS d_{a}" for a in NESTED) + ", " + ", ".join(f"count(DISTINCT ({a}, {b})) AS p_{a}_{b}" for a, b in NESTED_PAIRS) + " FROM sales), f AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, p_{a}_{b} = d_{a} AS x, p_{a}_{b} = d_{b} AS y FROM c" for a, b in NESTED_PAIRS) + ")"


def _nesting(spark, d):
    frame, _ = normalise(sales(spark, d))
    sizes = dict(zip(NESTED, distinct_groups(frame, [(c,) for c in NESTED])))
    return pt.Lattice.measure(frame, NESTED, NESTED_PAIRS, sizes)


@query(NEST_SQL + " SELECT CASE WHEN x THEN b ELSE a END AS coarse, CASE WHEN x THEN a ELSE b END AS fine FROM f WHERE x <> y")
def nesting_edges(spark, d):
    return spark.createDataFrame([tuple(e) for e in _nesting(spark, d).edges()], "coarse string, fine string")


@query(NEST_SQL + " SELECT a, b FROM f WHERE x AND y")
def value_aliases(spark, d):
    return spark.createDataFrame([tuple(x) for x in _nesting(spark, d).aliases(NESTED)], "a string, b string")


PREFIXES = [("n_regionkey",), ("n_regionkey", "c_nationkey"), ("n_regionkey", "c_nationkey", "c_mktsegment")]


@query(f"WITH {SALES} " + " UNION ALL ".join(f"SELECT '{'/'.join(p)}' AS prefix, count(*) AS groups FROM (SELECT DISTINCT {', '.join(p)} FROM sales)" for p in PREFIXES))
def prefix_counts(spark, d):
    found = distinct_groups(normalise(sales(spark, d))[0], PREFIXES)
    return spark.createDataFrame([("/".join(p), n) for p, n in zip(PREFIXES, found)], "prefix string, groups bigint")


def _impurity_sql(with_: str, source: str, prefixes, label: str) -> str:
    return with_ + " UNION ALL ".join(f"SELECT '{'/'.join(p)}' AS prefix, round(1 - sum(m) / sum(n), 6) AS impurity FROM (SELECT sum(n) AS n, max(n) AS m FROM (SELECT {', '.join(p)}, {label} AS l, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY {', '.join(p)})" for p in prefixes)


def _impurities(spark, frame, prefixes, label):
    return spark.createDataFrame([("/".join(p), round(x, 6)) for p, x in zip(prefixes, impurity(frame, prefixes, label))], "prefix string, impurity double")


@query(_impurity_sql(f"WITH {SALES} ", "sales", PREFIXES, "o_orderpriority"))
def path_impurity_target(spark, d):
    return _impurities(spark, normalise(sales(spark, d))[0], PREFIXES, F.col("o_orderpriority"))


@query(_impurity_sql(f"WITH {LABELLED} ", "lab", [("lang",), ("lang", "source")], SIG))
def path_impurity_availability(spark, d):
    return _impurities(spark, normalise(labelled(spark, d))[0], [("lang",), ("lang", "source")], av.signature(MARKED))


def _path_sql(budget: int = 40, shown: int = 3) -> str:
    """The search's levels: the best order of every set of two columns, its extensions, and the best of those by set."""
    n = lambda cols: "n_" + "_".join(sorted(cols))
    fixes = lambda a, b: f"({n((a, b))} = {n((a,))})"

    def score(order):
        sizes = [n(order[: i + 1]) for i in range(len(order))]
        terms = [f"{x} / {budget}.0 + greatest(0, {x} - {budget}) / {budget}.0" for x in sizes]
        terms += [f"CASE WHEN {x} = {y} THEN 2 ELSE 0 END" for x, y in zip(["1", *sizes], sizes)]
        for i, a in enumerate(order):
            for b in order[:i]:  # b stands before a
                terms.append(f"CASE WHEN {fixes(a, b)} AND {fixes(b, a)} THEN 3 WHEN {fixes(b, a)} THEN 8 ELSE 0 END")
        return " + ".join(terms)

    def level(size):
        rows = [f"SELECT {list(o)} AS path, {list(o[:-1])} AS start, {sorted(o)} AS members, {score(o)} AS score FROM c" for o in permutations(NESTED, size)]
        return " UNION ALL ".join(rows)

    counts = ", ".join(f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM sales)) AS {n(s)}" for k in (1, 2, 3) for s in combinations(NESTED, k))
    family = " ".join(f"WHEN x = '{a}' THEN least('{a}', " + ", ".join(f"CASE WHEN {fixes(a, b)} AND {fixes(b, a)} THEN '{b}' END" for b in NESTED if b != a) + ")" for a in NESTED)
    return f"""WITH {SALES}, c AS (SELECT {counts}),
two AS (SELECT * FROM ({level(2)}) QUALIFY row_number() OVER (PARTITION BY members ORDER BY score, path) = 1),
three AS (SELECT * FROM ({level(3)}) WHERE start IN (SELECT path FROM two) QUALIFY row_number() OVER (PARTITION BY members ORDER BY score, path) = 1),
f AS (SELECT path, score, (SELECT list_sort(list_distinct(list(CASE {family} END))) FROM (SELECT unnest(path) AS x), c) AS family FROM three),
kept AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY family ORDER BY score, path) = 1)
SELECT array_to_string(path, '/') AS path, round(score, 6) AS score FROM kept ORDER BY score, path LIMIT {shown}"""


@query(_path_sql())
def path_scores(spark, d):
    found = pt.suggest_paths(sales(spark, d), features=NESTED, max_dimensions=3, identify=False)
    return spark.createDataFrame([("/".join(x["dimensions"]), round(x["measurements"]["score"], 6)) for x in found["paths"]], "path string, score double")


# ---- value patterns -----------------------------------------------------------------------------------------


def _strings_sql(expr: str) -> str:
    return f"SELECT {expr} AS text, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1"


def _strings(spark, d, part):
    frame, _ = normalise(table(spark, d, "part"))
    return vp.string_table(positioned(frame, "p_partkey"), "p_name").where(F.col("part") == part).select("text", "n")


@query(_strings_sql(r"regexp_replace(regexp_replace(p_name, '\p{Nd}+', '9', 'g'), '[A-Za-z]+', 'A', 'g')"))
def string_formats(spark, d):
    return _strings(spark, d, "formats")


@query(_strings_sql("CAST(length(p_name) AS VARCHAR)"))
def string_lengths(spark, d):
    return _strings(spark, d, "lengths")


@query(_strings_sql("left(p_name, 3)"))
def string_prefixes(spark, d):
    return _strings(spark, d, "prefixes")


def _spacing_sql(source: str, c: str) -> str:
    return f"""SELECT '{c}' AS feature, min(v) AS minimum, max(v) AS maximum, round(min(s), 6) AS observed_step,
  (SELECT bool_and(abs((v - lo) / st - round_even((v - lo) / st, 0)) <= 1e-8 + 1e-5 * abs(round_even((v - lo) / st, 0))) FROM (SELECT DISTINCT CAST({c} AS DOUBLE) AS v FROM {source}), (SELECT min(v) AS lo, min(s) AS st FROM (SELECT v, v - lag(v) OVER (ORDER BY v) AS s FROM (SELECT DISTINCT CAST({c} AS DOUBLE) AS v FROM {source})))) AS on_grid
  FROM (SELECT v, v - lag(v) OVER (ORDER BY v) AS s FROM (SELECT DISTINCT CAST({c} AS DOUBLE) AS v FROM {source}))"""


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, min(CAST({c} AS DOUBLE)) AS minimum, max(CAST({c} AS DOUBLE)) AS maximum, CAST(0 AS BIGINT) AS nonfinite FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_linenumber")))
def numeric_range(spark, d):
    frame, _ = normalise(table(spark, d, "lineitem"))
    parts = [vp.spacing_table(frame, c).select(F.lit(c).alias("feature"), "minimum", "maximum", "nonfinite") for c in ("l_quantity", "l_extendedprice", "l_linenumber")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_spacing_sql("lineitem", "l_quantity") + " UNION ALL " + _spacing_sql("part", "p_size"))
def numeric_step(spark, d):
    parts = []
    for t, c in (("lineitem", "l_quantity"), ("part", "p_size")):
        frame, _ = normalise(table(spark, d, t))
        parts.append(vp.spacing_table(frame, c).select(F.lit(c).alias("feature"), "minimum", "maximum", F.round("observed_step", 6).alias("observed_step"), F.col("on_observed_step_grid").alias("on_grid")))
    return parts[0].unionByName(parts[1])


def _derived(spark, d):
    li = positioned(table(spark, d, "lineitem"), "l_orderkey")
    li = li.select(POSITION, "l_quantity", (F.col("l_quantity") + 3).alias("shifted"), (F.col("l_quantity") * 2).alias("doubled"), "l_tax")
    return vp.derived_table(li, [("l_quantity", "shifted"), ("l_quantity", "doubled"), ("l_quantity", "l_tax")])


@query("SELECT 'l_quantity' AS a, x.b, CASE WHEN x.ok THEN 3.0::DOUBLE END AS value, n AS rows, ok AS constant FROM (SELECT 'shifted' AS b, true AS ok UNION ALL SELECT 'doubled', (SELECT count(DISTINCT l_quantity) = 1 FROM lineitem) UNION ALL SELECT 'l_tax', (SELECT count(DISTINCT l_tax - l_quantity) = 1 FROM lineitem)) x, (SELECT count(*) AS n FROM lineitem)")
def numeric_offset(spark, d):
    return _derived(spark, d).where("kind = 'offset'").select("a", "b", F.when(F.col("constant"), F.col("value")).alias("value"), "rows", "constant")


@query("SELECT 'l_quantity' AS a, x.b, CASE WHEN x.ok THEN 2.0::DOUBLE END AS value, n AS rows, ok AS constant FROM (SELECT 'doubled' AS b, true AS ok UNION ALL SELECT 'shifted', (SELECT count(DISTINCT l_quantity) = 1 FROM lineitem) UNION ALL SELECT 'l_tax', (SELECT count(DISTINCT l_tax / l_quantity) = 1 FROM lineitem)) x, (SELECT count(*) AS n FROM lineitem WHERE l_quantity <> 0)")
def numeric_ratio(spark, d):
    return _derived(spark, d).where("kind = 'ratio'").select("a", "b", F.when(F.col("constant"), F.col("value")).alias("value"), "rows", "constant")


@query("WITH p AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1) SELECT 'o_orderstatus' AS feature, count(*) AS evaluated_groups, count(*) FILTER (s = 1) AS constant_groups FROM p UNION ALL SELECT 'o_orderpriority', count(*), count(*) FILTER (p = 1) FROM p")
def context_constancy(spark, d):
    frame, kinds = normalise(table(spark, d, "orders"))
    return vp.constancy_table(frame, kinds, ["o_orderstatus", "o_orderpriority"], ["o_custkey"])


# ---- two tables ---------------------------------------------------------------------------------------------


def _joined(spark, left, lk, right, rk, compare=(), match="typed"):
    l, lkind = normalise(left)
    r, rkind = normalise(right)
    key = lambda c, kinds: re_.match_key(quoted(c), kinds[c], match)
    tables = [re_.side_table(f, [key(k, kinds)], [key(p[i], kinds) for p in compare]) for i, (f, k, kinds) in enumerate(((l, lk, lkind), (r, rk, rkind)))]
    return re_.joined_table(*tables, len(compare))


FULL = "WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1), j AS (SELECT coalesce(l.n, 0) AS ln, coalesce(r.n, 0) AS rn FROM l FULL JOIN r ON l.k = r.k)"


@query(FULL + " SELECT count(*) FILTER (ln > 0) AS left_keys, count(*) FILTER (rn > 0) AS right_keys, count(*) FILTER (ln > 0 AND rn > 0) AS matched_keys, CAST(sum(ln) FILTER (rn > 0) AS BIGINT) AS left_matched_rows, CAST(sum(rn) FILTER (ln > 0) AS BIGINT) AS right_matched_rows FROM j")
def key_coverage(spark, d):
    j = _joined(spark, table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders"), "o_orderkey")
    return re_.relation_sums(j, 0).select("left_keys", "right_keys", "matched_keys", "left_matched_rows", "right_matched_rows")


@query(FULL + " SELECT CAST(sum(ln * rn) AS BIGINT) AS joined_rows, max(ln) FILTER (rn > 0) AS max_left, max(rn) FILTER (ln > 0) AS max_right, count(*) FILTER (ln > 1 AND rn > 0) AS left_repeated_matched, count(*) FILTER (rn > 1 AND ln > 0) AS right_repeated_matched FROM j")
def key_relation(spark, d):
    j = _joined(spark, table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders"), "o_orderkey")
    return re_.relation_sums(j, 0).select("joined_rows", "max_left", "max_right", "left_repeated_matched", "right_repeated_matched")


@query("""WITH l AS (SELECT c_nationkey AS k, count(DISTINCT c_mktsegment) AS d, min(c_mktsegment) AS v FROM customer GROUP BY 1), r AS (SELECT s_nationkey AS k, count(DISTINCT s_name) AS d, min(s_name) AS v FROM supplier GROUP BY 1)
SELECT count(*) FILTER (l.d = 1 AND r.d = 1 AND l.v = r.v) AS agree0, count(*) FILTER (l.d = 1 AND r.d = 1 AND l.v <> r.v) AS disagree0, count(*) FILTER (l.d > 1 OR r.d > 1) AS ambiguous0 FROM l JOIN r ON l.k = r.k""")
def value_agreement(spark, d):
    j = _joined(spark, table(spark, d, "customer"), "c_nationkey", table(spark, d, "supplier"), "s_nationkey", [("c_mktsegment", "s_name")])
    return re_.relation_sums(j, 1).select("agree0", "disagree0", "ambiguous0")


@query("SELECT count(*) AS matched_keys FROM (SELECT DISTINCT o_orderkey FROM orders) o JOIN (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS k FROM lineitem) l ON CAST(o_orderkey AS VARCHAR) = l.k")
def match_text(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("k"))
    return re_.relation_sums(_joined(spark, table(spark, d, "orders").withColumn("o", F.col("o_orderkey").cast("double")), "o", li, "k", match="text"), 0).select("matched_keys")


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS own, CASE WHEN turn > 1 THEN conv_id * 1000 + turn - 1 ELSE conv_id * 1000 + 2 END AS ref FROM conversations),
e AS (SELECT DISTINCT own, ref FROM t WHERE ref IN (SELECT own FROM t) AND own <> ref)
SELECT count(*) AS edges, count(*) FILTER (EXISTS (SELECT 1 FROM e b WHERE b.own = e.ref AND b.ref = e.own)) AS reciprocated FROM e""")
def self_reference(spark, d):
    t = table(spark, d, "conversations")
    own = F.col("conv_id") * 1000 + F.col("turn")
    ref = F.when(F.col("turn") > 1, own - 1).otherwise(F.col("conv_id") * 1000 + 2)
    return re_.reference_table(t, own, ref).where("own <> ref").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("reciprocated").cast("bigint")).alias("reciprocated"))


# ---- overview and selection ---------------------------------------------------------------------------------


RANKED = ["lang", "source", "quality", "toxic", "calm", "bad"]


def _leads_sql() -> str:
    """The dependency tests as findings, in order of candidate and target, with what they score as leads."""
    tests = " UNION ALL ".join(
        f"SELECT {i * len(RANKED) + j} AS i, '{k}' AS determinant, '{t}' AS target, (SELECT count(DISTINCT {t}) <= 1 FROM lab) AS flat, * FROM {_groups_sql('lab', k, t, f'{k} IS NOT NULL AND {t} IS NOT NULL')}"
        for i, k in enumerate(RANKED)
        for j, t in enumerate(RANKED)
        if k != t
    )
    return f"""WITH RECURSIVE {LABELLED}, tests AS ({tests}),
found AS (SELECT *, CASE WHEN violating_groups = 0 THEN 'exact_dependency' ELSE 'approximate_dependency' END AS pattern FROM tests WHERE evaluated_rows > 0 AND 1 - repair_rows / evaluated_rows >= 0.95),
named AS (SELECT *, CASE WHEN violating_groups > 0 THEN CASE WHEN repeated_rows = 0 THEN 'near-rule supported only by singleton groups'
    WHEN repeated_rows / evaluated_rows >= 0.25 AND 1 - repair_rows / repeated_rows >= 0.9 THEN 'near-rule with exceptions' ELSE 'near-rule with sparse repeated support' END
  WHEN flat THEN 'target is constant' WHEN repeated_rows = 0 THEN 'determinant is unique here' ELSE 'rule with repeated support' END AS reason FROM found),
scored AS (SELECT *, CASE reason WHEN 'near-rule supported only by singleton groups' THEN 0.2 WHEN 'near-rule with exceptions' THEN 0.9 WHEN 'near-rule with sparse repeated support' THEN 0.3
  WHEN 'target is constant' THEN 0.05 WHEN 'determinant is unique here' THEN 0.1 ELSE 0.5 END::DOUBLE / CASE WHEN row_number() OVER (PARTITION BY pattern, determinant ORDER BY i) = 1 THEN 1 ELSE 2 END AS score FROM named),
links AS (SELECT pattern AS kind, determinant, target FROM scored WHERE reason NOT IN ('target is constant', 'determinant is unique here')),
near AS (SELECT determinant AS a, target AS b FROM links UNION SELECT target, determinant FROM links),
reach AS (SELECT a, a AS b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a)"""


def _ranked(spark, d):
    from stratalens.operators.overview import explore

    return explore(labelled(spark, d), sections=["dependencies"], options={"dependencies": {"features": RANKED, "include_grain": False}}, position="doc_id")


@query(_leads_sql() + " SELECT pattern, determinant, target, reason, score, CAST(row_number() OVER (ORDER BY score DESC, i) AS INTEGER) AS place FROM scored")
def lead_ranking(spark, d):
    rows = [(f["pattern"], f["measurements"]["determinant"][0], f["measurements"]["target"], f["lead"]["reason"], f["lead"]["score"], i + 1) for i, f in enumerate(_ranked(spark, d).findings)]
    return spark.createDataFrame(rows, "pattern string, determinant string, target string, reason string, score double, place int")


@query(_leads_sql() + ", part AS (SELECT a, min(b) AS part FROM reach GROUP BY a) SELECT kind, determinant || ',' || target AS features, part FROM links JOIN part ON a = determinant")
def feature_network(spark, d):
    found = _ranked(spark, d)["feature_network"]
    part = {c: names[0] for names in found["components"] for c in names}
    rows = [(r["kind"], ",".join(f["column"] for f in r["features"]), part[r["features"][0]["column"]]) for r in found["relationships"]]
    return spark.createDataFrame(rows, "kind string, features string, part string")


@query(f"WITH {LABELLED} SELECT doc_id FROM lab WHERE quality IS NOT NULL AND calm IS NULL")
def select_exceptions(spark, d):
    df = labelled(spark, d)
    found = av.missingness(df, features=MARKED, min_implication=0.5, position="doc_id")
    record = next(f for f in found.findings if f["pattern"] == "presence_implication" and f["selector"]["source"] == "quality" and f["selector"]["target"] == "calm")
    return found.select(df, record["id"], exceptions=True, position="doc_id").rows.select(F.col(POSITION).alias("doc_id"))


@query(f"WITH {LABELLED} SELECT doc_id, lang FROM lab WHERE bad IS NOT NULL ORDER BY doc_id LIMIT 5")
def inspect_examples(spark, d):
    df = labelled(spark, d)
    found = av.missingness(df, features=MARKED, position="doc_id")
    record = next(f for f in found.findings if f["pattern"] == "availability" and f["selector"]["feature"] == "bad")
    return found.inspect(df, record["id"], position="doc_id").select("doc_id", "lang")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Which of the chain's keys determines which column: the tests behind region, nation, customer, order."""
    frame, kinds = normalise(sales(spark, d))
    parts = []
    for name, cols in KEYS.items():
        groups = modal(group_sizes(frame, list(cols), TARGETS, kinds), numbered(cols), False, missing_first=False)
        parts.append(dependency_measures(groups).select(F.lit(name).alias("key_name"), "feature", (F.col("violating_groups") == 0).alias("holds"), *MEASURES))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
