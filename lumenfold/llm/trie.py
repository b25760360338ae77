"""The prefix trie of rebuilt conversations, from digests of prefixes.

A conversation takes its first turns from the one that begins its block of ``BLOCK`` ids, and goes on with its own. A prefix
is told by its depth and two 64-bit digests, XORs of its turns' hashes salted by their place, so prefixes of one
conversation are running XORs, made in chunks of ``CHUNK`` turns with what comes before carried along: a conversation
of any length is spread over tasks, its places too, which come from a range partitioning and counts of its pieces.

The least conversation with a prefix owns its node, and what it owns begins at some depth and goes on to its end: a chain.
Each conversation's first owned depth is searched by halving, all conversations at once: one join of the depths in the middle
with the owners of the digests a round. The owner at the last depth not owned is the chain that it hangs on. Sums over
subtrees go up from chains on which none hangs: a round takes all chains whose own are done. Ids fall along a path of
chains, so rounds are few (in random order their number grows as the logarithm of the conversations).

Hashes of the conversations that end at a node are made of pieces of their sorted ids, joined by range partitioning, so
that the one task that must hash a node's list gets texts of up to a megabyte instead of rows.

Defined cases: a null role or text is empty; null turns come first; equal turns go by role and text; repeated rows are turns
each; a null conv_id is no conversation; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import materialize, ship

BLOCK, HEADS = 20, 4
CHUNK = 4096
#: Characters of a piece of a list of ids.
PIECE = 1 << 20
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PLACE = 1 << 33  # rows of a partition, as Spark numbers them


def placed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Turns (c, piece, at, t1, t2, words) in order, and pieces (c, piece, first, n, before): what a partition has of one."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), own(role_col).alias("role"), own(text_col).alias("text"))
    order = [F.asc("c"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    said = [F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)]
    words = F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).cast("long")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("c", *said, words.alias("words"), F.monotonically_increasing_id().alias("at"))
    rows = materialize(rows, "turns").withColumn("piece", F.floor(F.col("at") / _PLACE))
    pieces = rows.groupBy("c", "piece").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    return rows, materialize(pieces.withColumn("before", F.coalesce(before, F.lit(0))), "pieces")


def prefixes(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(c, length) of the rebuilt conversations and (c, d, g1, g2, words) of their prefixes from depth 1 on."""
    rows, pieces = placed(turns, conv_col, turn_col, role_col, text_col)
    place = (F.col("at") - F.col("first") + 1 + F.col("before")).alias("place")
    head = pieces.where((F.col("c") % BLOCK == 0) & (F.col("before") < HEADS)).select(F.col("c").alias("p_c"), F.col("piece").alias("p_piece"), "first", "before")
    head = rows.join(head, (F.col("c") == F.col("p_c")) & (F.col("piece") == F.col("p_piece"))).select("c", place, "t1", "t2", "words").where(F.col("place") < HEADS)
    head = head.groupBy(F.col("c").alias("h_c")).agg(F.sort_array(F.collect_list(F.struct("place", "t1", "t2", "words"))).alias("head"))  # three at most
    asked = F.crc32(F.col("c").cast("string")) % HEADS
    all_ = pieces.groupBy("c").agg(F.sum("n").alias("n")).withColumn("asked", asked).join(head, F.col("c") - F.col("c") % BLOCK == F.col("h_c"), "left")
    got = F.least("asked", F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    got = F.when(F.col("head").isNull(), F.lit(0)).otherwise(got)
    convs = all_.withColumn("got", got).withColumn("length", F.col("got") + F.greatest(F.col("n") - F.col("asked"), F.lit(0)))
    convs = materialize(convs.select("c", "asked", "got", "length", F.expr("slice(head, 1, int(got))").alias("head")), "rebuilt")
    inherited = convs.select("c", F.explode("head").alias("t")).select("c", F.col("t.place").alias("d"), "t.t1", "t.t2", "t.words")
    cut = pieces.join(convs.select("c", "asked", "got"), "c").select(F.col("c").alias("p_c"), F.col("piece").alias("p_piece"), "first", "before", "asked", "got")
    own = rows.join(cut, (F.col("c") == F.col("p_c")) & (F.col("piece") == F.col("p_piece"))).withColumn("place", place).where("place > asked")
    own = own.select("c", (F.col("place") - F.col("asked") + F.col("got")).alias("d"), "t1", "t2", "words")
    salted = [F.xxhash64(F.lit(k), "t1", "t2", "d").alias(f"m{k}") for k in (1, 2)]
    every = inherited.unionByName(own).select("c", "d", F.floor((F.col("d") - 1) / CHUNK).alias("chunk"), *salted, "words")
    running = Window.partitionBy("c", "chunk").orderBy("d")
    local = materialize(every.select("c", "d", "chunk", *[F.bit_xor(f"m{k}").over(running).alias(f"g{k}") for k in (1, 2)], "words"), "prefixes")
    # a chunk's last prefix is its sum
    last = local.where(F.col("d") % CHUNK == 0).select("c", (F.col("chunk") + 1).alias("chunk"), "g1", "g2")
    until = Window.partitionBy("c").orderBy("chunk")
    carry = last.select(F.col("c").alias("l_c"), F.col("chunk").alias("l_chunk"), *[F.bit_xor(f"g{k}").over(until).alias(f"b{k}") for k in (1, 2)])
    later = local.where("chunk > 0").join(carry, (F.col("c") == F.col("l_c")) & (F.col("chunk") == F.col("l_chunk")))
    later = later.select("c", "d", *[F.col(f"g{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"g{k}") for k in (1, 2)], "words")
    return convs.select("c", "length"), local.where("chunk = 0").select("c", "d", "g1", "g2", "words").unionByName(later)


def chains(convs: DataFrame, digests: DataFrame, owners: DataFrame) -> DataFrame:
    """(c, length, f, parent): f is the first depth that c owns (length + 1: none), parent the owner at depth f - 1 (null at 0)."""
    state = materialize(convs.select("c", "length", F.lit(1).cast("long").alias("lo"), (F.col("length") + 1).alias("hi"), F.lit(None).cast("long").alias("parent")), "search")
    own = owners.select(F.col("g1").alias("o1"), F.col("g2").alias("o2"), F.col("d").alias("o_d"), "owner").hint("merge")
    at = digests.select(F.col("c").alias("d_c"), "d", "g1", "g2").hint("merge")
    done = state.where("lo >= hi")
    state = state.where("lo < hi").withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2))
    while not state.isEmpty():
        probe = state.join(at, (F.col("c") == F.col("d_c")) & (F.col("mid") == F.col("d")))
        found = probe.join(own, (F.col("g1") == F.col("o1")) & (F.col("g2") == F.col("o2")) & (F.col("d") == F.col("o_d")))
        mine = F.col("owner") == F.col("c")
        found = found.select("c", "length", F.when(mine, F.col("lo")).otherwise(F.col("mid") + 1).alias("lo"), F.when(mine, F.col("mid")).otherwise(F.col("hi")).alias("hi"), F.when(mine, F.col("parent")).otherwise(F.col("owner")).alias("parent"))
        now = materialize(found, "search")
        done = done.unionByName(now.where("lo >= hi"))
        state = now.where("lo < hi").withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2))
    return materialize(done.select("c", "length", F.col("lo").alias("f"), "parent"), "chains")


def _upward(chain: DataFrame) -> DataFrame:
    """(c, parent, a, saved, leaves) of chains (c, parent, a, saved, leaves, waits) with those of the chains that hang on each added."""
    done, left = None, materialize(chain, "waiting")
    while not left.isEmpty():
        ready = left.where("waits = 0").drop("waits")
        done = ready if done is None else done.unionByName(ready)
        sums = ready.where("a > 0").groupBy(F.col("parent").alias("s_c")).agg(F.sum("saved").alias("s_saved"), F.sum("leaves").alias("s_leaves"), F.count(F.lit(1)).alias("s_n"))
        more = lambda c, s: (F.col(c) + F.coalesce(F.col(s), F.lit(0))).alias(c)
        rest = left.where("waits > 0").join(sums, F.col("c") == F.col("s_c"), "left")
        left = materialize(rest.select("c", "parent", "a", more("saved", "s_saved"), more("leaves", "s_leaves"), (F.col("waits") - F.coalesce("s_n", F.lit(0))).alias("waits")), "waiting")
    return done if done is not None else left.drop("waits")


def _hashes(ends: DataFrame) -> DataFrame:
    """(e_c, e_d, ends_sha256) of the conversations (e_c, e_d, c) that end at each node."""
    ship(ends.sparkSession)
    order = ["e_c", "e_d", "c"]

    def pieces(batches):
        at, first, text, size = None, None, [], 0
        for b in batches:
            rows = []
            for e_c, e_d, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if at != (e_c, e_d) or size > PIECE:
                    if text:
                        rows.append((*at, first, ",".join(text)))
                    at, first, text, size = (e_c, e_d), c, [], 0
                text.append(str(c))
                size += len(text[-1]) + 1
            if rows:
                yield _batch(rows)
        if text:
            yield _batch([(*at, first, ",".join(text))])

    def whole(batches):
        at, made = None, None
        for b in batches:
            rows = []
            for e_c, e_d, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if at == (e_c, e_d):
                    made.update(b"," + text.encode())
                    continue
                if made:
                    rows.append((*at, made.hexdigest()))
                at, made = (e_c, e_d), hashlib.sha256(text.encode())
            if rows:
                yield _batch(rows)
        if made:
            yield _batch([(*at, made.hexdigest())])

    def _batch(rows):
        names = ["e_c", "e_d", "c", "text"] if len(rows[0]) == 4 else ["e_c", "e_d", "ends_sha256"]
        kinds = [pa.int64()] * (len(names) - 1) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    cut = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "e_c long, e_d long, c long, text string")
    return cut.repartition("e_c", "e_d").sortWithinPartitions(*order).mapInArrow(whole, "e_c long, e_d long, ends_sha256 string")


def trie(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    convs, digests = prefixes(turns, conv_col, turn_col, role_col, text_col)
    least, total = convs.agg(F.min("c"), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], NODES)
    owners = materialize(digests.groupBy("g1", "g2", "d").agg(F.min("c").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words")), "owners")
    chain = chains(convs, digests, owners).withColumn("a", F.col("f") - 1)
    nodes = owners.select(F.col("owner").alias("c"), "d", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    full = chain.where("f <= length")
    # on how many chains each waits, and whether one hangs on its last node
    hung = full.where("a > 0").groupBy(F.col("parent").alias("w_c")).agg(F.count(F.lit(1)).alias("waits"), F.max("a").alias("deepest"))
    own = nodes.groupBy(F.col("c").alias("n_c")).agg(F.sum("own").alias("saved"))
    begun = full.join(own, F.col("c") == F.col("n_c")).join(hung, F.col("c") == F.col("w_c"), "left")
    leaf = F.when(F.col("deepest") == F.col("length"), F.lit(0)).otherwise(F.lit(1)).cast("long")
    sums = materialize(_upward(begun.select("c", "parent", "a", "saved", leaf.alias("leaves"), F.coalesce("waits", F.lit(0)).cast("long").alias("waits"))), "subtrees")
    # all that is known of a node beside its members: one row each, then one join
    none = F.lit(None).cast("long")
    ended = chain.select(F.when(F.col("length") == 0, F.lit(least)).when(F.col("f") <= F.col("length"), F.col("c")).otherwise(F.col("parent")).alias("e_c"), F.col("length").alias("e_d"), "c")
    hashes = materialize(_hashes(ended), "ends")
    zero, text = F.lit(0).cast("long"), F.lit(None).cast("string")
    tops = full.select("c", F.col("f").alias("d"), F.coalesce("parent", F.lit(least)).alias("up"), zero.alias("last"), zero.alias("kids"), zero.alias("k_saved"), zero.alias("k_leaves"), text.alias("sha"))
    lasts = full.select("c", F.col("length").alias("d"), none.alias("up"), (zero + 1).alias("last"), zero.alias("kids"), zero.alias("k_saved"), zero.alias("k_leaves"), text.alias("sha"))
    kids = sums.where("a > 0").groupBy(F.col("parent").alias("c"), F.col("a").alias("d")).agg(F.count(F.lit(1)).alias("kids"), F.sum("saved").alias("k_saved"), F.sum("leaves").alias("k_leaves"))
    kids = kids.select("c", "d", none.alias("up"), zero.alias("last"), "kids", "k_saved", "k_leaves", text.alias("sha"))
    shas = hashes.where("e_d > 0").select(F.col("e_c").alias("c"), F.col("e_d").alias("d"), none.alias("up"), zero.alias("last"), zero.alias("kids"), zero.alias("k_saved"), zero.alias("k_leaves"), F.col("ends_sha256").alias("sha"))
    facts = tops.union(lasts).union(kids).union(shas).groupBy(F.col("c").alias("f_c"), F.col("d").alias("f_d")).agg(F.max("up").alias("up"), *[F.sum(x).alias(x) for x in ("last", "kids", "k_saved", "k_leaves")], F.max("sha").alias("sha"))
    held = nodes.join(facts, (F.col("c") == F.col("f_c")) & (F.col("d") == F.col("f_d")), "left").drop("f_c", "f_d").fillna(0, ["last", "kids", "k_saved", "k_leaves"])
    leaf = F.when((F.col("last") == 1) & (F.col("kids") == 0), F.lit(1)).otherwise(F.lit(0))
    held = held.select("c", "d", F.floor((F.col("d") - 1) / CHUNK).alias("chunk"), "n_convs", "up", (F.col("kids") + 1 - F.col("last")).alias("n_children"), (F.col("own") + F.col("k_saved")).alias("s"), (F.col("k_leaves") + leaf).alias("l"), "sha")
    # from a chain's end to its top, chunk by chunk
    down = Window.partitionBy("c", "chunk").orderBy(F.desc("d"))
    held = materialize(held.select("*", F.sum("s").over(down).alias("saved"), F.sum("l").over(down).alias("leaves")), "nodes")
    chunk = held.groupBy(F.col("c").alias("k_c"), F.col("chunk").alias("k_chunk")).agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    after = Window.partitionBy("k_c").orderBy(F.desc("k_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = chunk.select("k_c", "k_chunk", F.sum("s").over(after).alias("s_after"), F.sum("l").over(after).alias("l_after")).where("s_after is not null")
    held = held.drop("s", "l").join(carry, (F.col("c") == F.col("k_c")) & (F.col("chunk") == F.col("k_chunk")), "left").fillna(0, ["s_after", "l_after"])
    empty = hashlib.sha256(b"").hexdigest()
    long = lambda x, name: x.cast("long").alias(name)
    below = held.select(
        long(F.col("c"), "conv_id"), long(F.col("d"), "depth"), long(F.coalesce("up", "c"), "parent_conv_id"), long(F.col("n_convs"), "n_convs"), long(F.col("n_children"), "n_children"),
        long(F.col("leaves") + F.col("l_after"), "n_leaves"), long(F.col("saved") + F.col("s_after"), "saved_tokens"), F.coalesce("sha", F.lit(empty)).alias("ends_sha256"),
    )
    top = sums.where("a = 0").agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("leaves"), F.lit(1)).alias("l"), F.coalesce(F.sum("saved"), F.lit(0)).alias("s"))
    sha = hashes.where("e_d = 0").agg(F.coalesce(F.max("ends_sha256"), F.lit(empty)).alias("sha"))
    top = top.crossJoin(sha)  # one row each
    root = top.select(long(F.lit(least), "conv_id"), long(F.lit(0), "depth"), none.alias("parent_conv_id"), long(F.lit(total), "n_convs"), long(F.col("k"), "n_children"), long(F.col("l"), "n_leaves"), long(F.col("s"), "saved_tokens"), F.col("sha").alias("ends_sha256"))
    return below.unionByName(root)


#: Crc-32 by its table (polynomial 0xEDB88320), bit by bit; prefixes as lists; subtrees by each node's ancestors.
SQL = r"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
crcs AS (SELECT b, CAST(v AS BIGINT) AS v FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, i, r) AS (
  SELECT c, s, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL SELECT c, s, i + 1, xor(r // 256, v) FROM crc JOIN crcs ON b = xor(r % 256, ascii(substr(s, i + 1, 1))) WHERE i < length(s)),
heads AS (SELECT c, xor(r, 4294967295) % 4 AS h FROM crc WHERE i = length(s)),
raw AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list(t ORDER BY i) AS ts FROM raw GROUP BY c),
rebuilt AS (SELECT l.c, list_concat(coalesce(p.ts, [])[1 : h.h], l.ts[h.h + 1 :]) AS ts FROM lists l JOIN heads h ON h.c = l.c LEFT JOIN lists p ON p.c = l.c - l.c % 20),
members AS (SELECT c, u.d, ts[1 : u.d] AS p, ts FROM rebuilt, unnest(range(0, len(ts) + 1)) u(d)),
nodes AS (SELECT p, d, min(c) AS c, count(*) AS n, coalesce(sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(ts) = d)), sha256('')) AS ends,
  CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS own FROM members GROUP BY p, d),
kids AS (SELECT p[1 : d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
flat AS (SELECT n.*, coalesce(k.k, 0) AS k FROM nodes n LEFT JOIN kids k ON k.p = n.p),
up AS (SELECT f.p[1 : u.a] AS p, sum(own) AS saved, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves FROM flat f, unnest(range(0, f.d + 1)) u(a) GROUP BY 1)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, b.c AS parent_conv_id, f.n AS n_convs, f.k AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM flat f JOIN up u ON u.p = f.p LEFT JOIN nodes b ON f.d > 0 AND b.p = f.p[1 : f.d - 1]
"""
