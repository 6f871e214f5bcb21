"""A Merkle manifest of a table: levels of digests as linked node rows, and a recursive query that climbs from each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowmill.llm.common import cut, join_split, part_offsets, put_in_order

#: Levels that a node row spans: it links to the ancestor so many levels up and holds the siblings on the way.
HOP = 4
#: A node above more leaves than this is stored once for each so many of them, so that no key of the climb's joins is hot.
SPREAD = 4096
#: The tree over the trees' roots; the level of a root, which is a leaf of that tree.
TOP, ROOT = -1, -1
_KEY = "struct<tree:long,level:int,idx:long>"
NODES = "tree long, level int, idx long, salt long, path array<struct<left:binary,right:binary>>, up_tree long, up_level int, up_idx long, up_copies long"


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def row_digest(*values: Column) -> Column:
    """SHA-256 (binary) of the values one behind the other: each as its UTF-8 length, a colon and its text; null as '-'."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return _hash(F.concat(*parts))


def number_leaves(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows (tree, order columns, and others) written in order, with leaf (place among all rows, from 0), idx (place within its
    tree), size (rows of the tree) and first (place of the tree's first row, which names the tree). Trees come by their
    value, null first. Rows that tie in all of order take their places as they were read."""
    ordered = put_in_order(rows.withColumn("_tie", F.monotonically_increasing_id()), tree, *order, "_tie", name="leaves")
    counts = ordered.groupBy("_part", tree).agg(F.count("*").alias("n"))
    before = part_offsets(counts.groupBy("_part").agg(F.sum("n").alias("n")), "n")
    inside = Window.partitionBy("_part").orderBy(tree).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(tree)
    counts = counts.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "_part").withColumn("at", F.col("_in") + F.col("before_n"))
    counts = cut(counts.select(F.col("_part").alias("_p"), F.col(tree).alias("_t"), "at", F.min("at").over(whole).alias("first"), F.sum("n").over(whole).alias("size")), "places")
    nth = F.row_number().over(Window.partitionBy("_part", tree).orderBy(*order, "_tie")) - 1
    out = ordered.withColumn("_nth", nth).join(counts, (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_t")))
    leaf = F.col("at") + F.col("_nth")
    return cut(out.select(*rows.columns, leaf.alias("leaf"), (leaf - F.col("first")).alias("idx"), "size", "first"), "numbered")


def _next(run: Column, fanout: int) -> Column:
    """The parents of a stretch of neighbours (digest, n), fanout to each."""
    def parent(i):
        own = F.slice(run, i * fanout + 1, fanout)
        text = F.aggregate(own, F.lit(""), lambda a, x: F.concat(a, _text(x["digest"])))
        return F.struct(_hash(text).alias("digest"), F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"))

    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(run) / fanout).cast("int") - 1), parent)


def _side(run: Column, begin: Column, end: Column) -> Column:
    """The digests of run from begin to before end, joined."""
    own = F.slice(run, begin + 1, F.greatest(F.least(end, F.size(run)) - begin, F.lit(0)))
    return F.aggregate(own, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["digest"]))


def _copies(n: Column) -> Column:
    return F.greatest(F.floor(n / SPREAD), F.lit(1)).cast("long")


def _fold(rows: DataFrame, level: int, fanout: int, hop: int) -> DataFrame:
    """rows: grp (a tree), size (its nodes at this level, over 1), idx, digest, n (leaves below), key (how links name the node).
    A row for each stretch of fanout**hop neighbours: nodes, its node rows, and tops, what is hop levels above it, or as far
    up as the tree goes."""
    width = fanout**hop
    g = rows.groupBy("grp", "size", F.floor(F.col("idx") / width).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest", "n", "key"))).alias("c"))
    g = g.withColumn("run0", F.transform("c", lambda x: F.struct(x["digest"], x["n"])))
    left = lambda s: F.ceil(F.col("size") / fanout**s)  # noqa: E731  nodes of the tree s levels up
    for s in range(hop):
        g = g.withColumn(f"run{s + 1}", F.when(left(s) > 1, _next(F.col(f"run{s}"), fanout)).otherwise(F.col(f"run{s}")))
    ended = left(hop) <= 1

    def node(x, i):
        path = []
        for s in range(hop):
            run, at = F.col(f"run{s}"), F.floor(i / fanout**s).cast("int")
            begin = F.floor(at / fanout).cast("int") * fanout
            path.append(F.when(left(s) > 1, F.struct(_side(run, begin, at).alias("left"), _side(run, at + 1, begin + fanout).alias("right"))))
        above = F.when(ended, F.lit(0)).otherwise(F.floor(i / width).cast("int"))
        return F.struct(
            x["key"].alias("key"), x["n"].alias("n"), F.array_compact(F.array(*path)).alias("path"), F.col("grp").alias("up_tree"), F.when(ended, F.lit(ROOT)).otherwise(F.lit(level + hop)).alias("up_level"),
            F.when(ended, F.lit(0)).otherwise(F.col("block")).cast("long").alias("up_idx"), _copies(F.get(F.col(f"run{hop}"), above)["n"]).alias("up_copies"),
        )

    # named size only later: inside a lambda, a name would mean the alias beside it
    return g.select("grp", left(hop).cast("long").alias("_left"), "block", F.transform("c", node).alias("nodes"), F.col(f"run{hop}")[0].alias("top")).withColumnRenamed("_left", "size")


def _levels(rows: DataFrame, largest: int, fanout: int, hop: int) -> tuple[list[DataFrame], DataFrame]:
    """Node rows of the trees in rows, a table for each hop of levels, and their roots (grp, digest, n). largest: the most
    nodes of a tree; only this number is known to the driver."""
    nodes, roots, level = [], [rows.where("size = 1").select("grp", "digest", "n")], 0
    while largest > 1:
        made = cut(_fold(rows.where("size > 1"), level, fanout, hop), "levels")
        nodes.append(made.select(F.explode("nodes").alias("x")).select("x.*"))
        level, largest = level + hop, -(-largest // fanout**hop)
        rows = made.select("grp", "size", F.col("block").alias("idx"), "top.*").withColumn("key", F.struct(F.col("grp").alias("tree"), F.lit(level).alias("level"), F.col("idx").alias("idx")).cast(_KEY))
        roots.append(rows.where("size = 1").select("grp", "digest", "n"))
    every = roots[0]
    for r in roots[1:]:
        every = every.unionByName(r)
    return nodes, cut(every, "roots")


def build(rows: DataFrame, tree: str, order: list[str], digest: str, fanout: int = 2, hop: int = HOP):
    """The manifest of rows, a tree for each value of the column tree with its rows as leaves by order, then by digest; every
    fanout neighbours are hashed into their parent, the last ones also if they are fewer, until one is left; the roots, by
    tree with null first, likewise. Returns (leaves, nodes, roots, root): leaves are rows with leaf, idx, size and first, as
    number_leaves gives them; nodes are the stored node rows (NODES); roots (grp: the tree's first, digest, n); root is the
    digest of all, None for an empty table. Rows that are equal are leaves of their own.

    A level is made from stretches of fanout**hop neighbours, never from a whole tree."""
    spark = rows.sparkSession
    leaves = number_leaves(rows, tree, *order, digest)
    largest = leaves.agg(F.max("size")).first()[0] or 0
    named = lambda t, level, i: F.struct(t.alias("tree"), F.lit(level).alias("level"), i.alias("idx")).cast(_KEY)
    base = leaves.select(F.col("first").alias("grp"), "size", "idx", F.col(digest).alias("digest"), F.lit(1).cast("long").alias("n"), named(F.col("first"), 0, F.col("idx")).alias("key"))
    nodes, roots = _levels(base, largest, fanout, hop)
    # trees are named by the place of their first leaf, so that number has their order
    tops = number_leaves(roots.withColumn("_all", F.lit(0)), "_all", "grp")
    base = tops.select(F.lit(TOP).cast("long").alias("grp"), "size", "idx", "digest", "n", named(F.col("grp"), ROOT, F.lit(0)).alias("key"))
    more, top = _levels(base, tops.count(), fanout, hop)
    every = spark.createDataFrame([], NODES)
    for n in [*nodes, *more]:
        salts = F.explode(F.sequence(F.lit(0).cast("long"), _copies(F.col("n")) - 1)).alias("salt")
        every = every.unionByName(n.select("key.*", salts, "path", "up_tree", "up_level", "up_idx", "up_copies"))
    root = top.first()
    return leaves, cut(every, "nodes"), roots, None if root is None else bytes(root["digest"])


_CLIMB = """
with recursive climb (leaf, step, tree, level, idx, salt, sides, folded) as (
 select leaf, 0, first, case when size = 1 then {root} else 0 end, idx, 0L, cast('' as binary), {start} from {{leaves}}
 union all
 select c.leaf, c.step + 1, n.up_tree, n.up_level, n.up_idx, pmod(c.leaf, n.up_copies),
  aggregate(n.path, cast('' as binary), (a, p) -> concat(a, p.left, p.right)),
  aggregate(n.path, c.folded, (h, p) -> unhex(sha2(cast(lower(concat(hex(p.left), hex(h), hex(p.right))) as binary), 256)))
 from climb c join {{nodes}} n on c.tree = n.tree and c.level = n.level and c.idx = n.idx and c.salt = n.salt
)
select leaf, step, sides, case when level = {root} then folded end as folded from climb"""


def climb(spark: SparkSession, leaves: DataFrame, nodes: DataFrame, start: str) -> DataFrame:
    """leaves and nodes of build(). For each leaf: leaf, siblings (binary, the digests beside its path to the root, level by
    level, left to right) and folded: the root that follows from the digest in the column start and those siblings.

    A recursive query goes up from all leaves at once and joins the node rows of each hop. Nodes with many leaves are
    stored several times, and leaves are dealt among the copies. Each step appends a row with the siblings it met; a
    leaf's few rows are put together in the end, so no row grows with the height."""
    limit = "spark.sql.cteRecursionRowLimit"  # 1,000,000 by default; the climb has a row for each leaf and hop
    had = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        # a leaf's last row is at a root, so digests of the others are not kept
        steps = cut(spark.sql(_CLIMB.format(root=ROOT, start=start), leaves=leaves, nodes=nodes), "climb")
    finally:
        spark.conf.unset(limit) if had is None else spark.conf.set(limit, had)
    rows = F.array_sort(F.collect_list(F.struct("step", "sides")))
    g = steps.groupBy("leaf").agg(rows.alias("rows"), F.max_by("folded", "step").alias("folded"))
    return g.select("leaf", F.aggregate("rows", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["sides"])).alias("siblings"), "folded")


def verify(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree: str = "lang", key: str = "doc_id", changed: dict[str, Column] | None = None, fanout: int = 2, hop: int = HOP) -> DataFrame:
    """The manifest of docs, and for each row whether it still fits it. changed says what became of columns since (none:
    nothing). Columns: key, leaf, subroot, root, siblings (binary), folded_root, verified; digests are hexadecimal text.

    Null fields have a digest of their own, null trees come first, null keys before others. Equal rows are leaves of their
    own; rows with equal keys are ordered by digest. An empty table gives no rows. Other columns are not looked at."""
    spark = docs.sparkSession
    now = [(changed or {}).get(c, F.col(c)) for c in fields]
    slim = docs.select(F.col(key).alias("key"), F.col(tree).alias("tree"), row_digest(*map(F.col, fields)).alias("digest"), row_digest(*now).alias("found"))
    leaves, nodes, roots, root = build(slim, "tree", ["key"], "digest", fanout, hop)
    up = climb(spark, leaves, nodes, "found")
    ways = leaves.select("leaf", "key", "first", F.col("digest").alias("own")).join(up, "leaf")
    subroots = roots.select(F.col("grp").alias("first"), F.col("digest").alias("subroot"), "n")
    out = join_split(ways, subroots, "first", "n", leaves.count())
    whole = F.lit(None if root is None else root.hex())
    folded = _text(F.col("folded"))
    return out.select(F.col("key").alias(key), _text(F.col("own")).alias("leaf"), _text(F.col("subroot")).alias("subroot"), whole.alias("root"), "siblings", folded.alias("folded_root"), (folded == whole).alias("verified"))
