"""Balanced shards by label propagation over linked documents, in DataFrame functions only.

Documents are linked when they share a group (by default: equal texts), all with
all; the links are never written out, since documents of a group that lie in one
shard are interchangeable.  The state is a table of cells (group, shard, count).

1.  One global order of the narrow rows (group, doc_id) gives every document a
    position and every group a first position.
2.  Labels to begin with: the linked documents go round the shards, so a group is
    spread and no shard holds more linked documents than its quota.
3.  A round: every cell proposes to move to the shard where most of its neighbours
    are (among those with room, else the fullest, by exchange).  Proposals of a pair
    of shards are ordered by gain; opposite ones are exchanged, the rest shares the
    free quota of the target shard.  What exceeds that stays where it is.  Every move
    goes to a cell that is at least as full, so fewer links are cut.
4.  Rounds end when no move is allowed, at ``ROUNDS`` at most (then the labels of
    that round stand: the quotas hold after every round).
5.  Documents without a link fill each shard up to its quota, in order.

Quotas are the law ``rows``: counts of any two shards differ by at most one.  A
group larger than a shard's quota fills several.

Only narrow rows (id, size, checksum, group digest) are shuffled, texts never.  The
driver reads counts of shards and of pairs of shards (at most shards squared) and
one number per range partition.  Joins of documents with groups are salted by
blocks of ``BLOCK`` positions, so a group of any share of the rows is split.

Defined cases: a null text is an empty one (size 8, checksum 0), and all empty texts
are one group; a null group of the caller's is linked with nothing; a null id is
kept and ordered last; rows that repeat are documents of their own; other columns
are ignored, whatever their names; very long texts are read once, by size, checksum
and digest; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import global_position, running_sum
from ..session import cut_lineage

SHARDS = 24
ROUNDS = 40
BLOCK = 1 << 16  # positions that share a salt


def _numbers(values, at: Column) -> Column:
    """The value at a (0-based) place of a short list that the driver knows."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), (at + 1).cast("int"))


def _narrow(docs: DataFrame, id_col: str, text_col: str, group: Column | None) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    own = F.sha2(text, 256) if group is None else F.coalesce(
        F.concat(F.lit("g"), F.sha2(group.cast("string").cast("binary"), 256)),
        F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string")))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), own.alias("_key"))


def _allowed(wanted: dict, free: list) -> dict:
    """Moves from shard to shard: opposite proposals exchanged, free places shared by what else is proposed."""
    n = len(free)
    allowed = {k: min(v, wanted.get((k[1], k[0]), 0)) for k, v in wanted.items()}
    for t in range(n):
        room = free[t]
        asks = sorted(((wanted[s, t] - allowed[s, t], s) for s in range(n) if (s, t) in wanted), reverse=True)
        total = sum(a for a, _ in asks)
        if room <= 0 or not total:
            continue
        share = {s: min(a, room * a // total) for a, s in asks}
        rest = min(room, total) - sum(share.values())
        for a, s in asks:
            more = min(rest, a - share[s])
            share[s] += more
            rest -= more
            allowed[s, t] += share[s]
    return {k: v for k, v in allowed.items() if v > 0}


def _propose(cells: DataFrame, free: list) -> DataFrame:
    """(_key, _s, _t, _c, _gain): each cell and the shard that its documents want to move to."""
    rank = F.struct((-F.col("_c")).alias("n"), F.xxhash64("_key", "_s").alias("h"), F.col("_s").alias("s"))
    groups = cells.groupBy("_key").agg(F.sort_array(F.collect_list(rank)).alias("_best"))  # at most one per shard
    room = F.array(*[F.lit(f > 0) for f in free])
    open_ = F.filter("_best", lambda x: F.element_at(room, (x["s"] + 1).cast("int")))
    each = groups.where(F.size("_best") > 1).select(
        "_key", F.col("_best")[0].alias("_top"), F.get(open_, F.lit(0)).alias("_open"),
        F.explode("_best").alias("_me"))
    target = F.when(F.col("_open") < F.col("_me"), F.col("_open")).when(F.col("_top") < F.col("_me"), F.col("_top"))
    return (each.withColumn("_to", target).where(F.col("_to").isNotNull())
            .select("_key", F.col("_me.s").alias("_s"), F.col("_to.s").alias("_t"), (-F.col("_me.n")).alias("_c"),
                    (F.col("_me.n") - F.col("_to.n")).alias("_gain")))


def propagate(cells: DataFrame, quota: list, rounds: int = ROUNDS) -> DataFrame:
    """Cells (_key, _s, _c) after moves towards the groups' fullest shards; no shard passes its quota
    unless it did before."""
    n = len(quota)
    for _ in range(rounds):
        load = dict(cells.groupBy("_s").agg(F.sum("_c")).collect())
        free = [quota[s] - (load.get(s) or 0) for s in range(n)]
        asks = cut_lineage(_propose(cells, free), "shard-asks")
        wanted = {(r[0], r[1]): r[2] for r in asks.groupBy("_s", "_t").agg(F.sum("_c")).collect()}
        allowed = _allowed(wanted, free)
        if not allowed:
            break
        pair = F.col("_s") * n + F.col("_t")
        pairs = [(s, t) for s in range(n) for t in range(n)]
        # only proposals of pairs with an allowance take part in the order
        part = asks.where(_numbers([allowed.get(p, 0) for p in pairs], pair) > 0)
        starts = accumulate((wanted[p] if p in allowed else 0 for p in pairs), initial=0)
        order = running_sum(part, ["_s", "_t", ("_gain", True), "_key"], "_c", "_run")
        moves = order.select("_key", "_s", "_t", F.least(F.col("_c"), _numbers(
            [allowed.get(p, 0) for p in pairs], pair) - (F.col("_run") - _numbers(
                [a for a, _ in zip(starts, pairs, strict=False)], pair))).alias("_m")).where("_m > 0")
        change = moves.select("_key", F.explode(F.array(
            F.struct(F.col("_s").alias("_s"), (-F.col("_m")).alias("_c")),
            F.struct(F.col("_t").alias("_s"), F.col("_m").alias("_c")))).alias("x")).select("_key", "x._s", "x._c")
        cells = cut_lineage(cells.unionByName(change).groupBy("_key", "_s").agg(F.sum("_c").alias("_c"))
                            .where("_c > 0"), "shard-cells", replaces=cells)
    return cells


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, group: Column | None = None,
                    id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    narrow = cut_lineage(_narrow(docs, id_col, text_col, group), "shard-rows")
    placed = global_position(narrow, ["_key", "doc_id"], "_pos")
    groups = placed.groupBy("_key").agg(F.min("_pos").alias("_start"), F.count("*").alias("_n"))
    groups = groups.withColumn("_linked", F.when(F.col("_n") > 1, F.col("_n")).otherwise(0))
    # linked documents before each group; the others before it are _start - _lstart
    groups = running_sum(groups, ["_start"], "_linked", "_lstart")
    total = groups.agg(F.sum("_n")).first()[0] or 0
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    lot = F.least(F.col("_n"), F.lit(shards)).cast("long") - 1
    cells = (groups.where("_linked > 0").select("_key", "_n", "_lstart", F.explode(F.sequence(F.lit(0).cast("long"), lot)).alias("_i"))
             .select("_key", F.pmod(F.col("_lstart") + F.col("_i"), F.lit(shards)).cast("int").alias("_s"),
                     (F.floor((F.col("_n") - 1 - F.col("_i")) / shards) + 1).cast("long").alias("_c")))
    cells = propagate(cut_lineage(cells, "shard-cells"), quota, rounds)

    load = dict(cells.groupBy("_s").agg(F.sum("_c")).collect())
    load = [load.get(s) or 0 for s in range(shards)]
    firsts = list(accumulate(load, initial=0))
    # slots of linked documents: the cells of a shard one after the other
    laid = running_sum(cells, ["_s", "_key"], "_c", "_run").withColumn(
        "_base", F.col("_run") - _numbers(firsts, F.col("_s")))
    ends = laid.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_s", "_c", "_base"))).alias("_cells"))
    upto = F.transform("_cells", lambda x, i: F.struct(
        x["_s"].alias("s"), x["_base"].alias("base"), x["_c"].alias("c"),
        F.aggregate(F.slice("_cells", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["_c"]).alias("before")))
    known = (groups.join(ends.select("_key", upto.alias("_cells")), "_key", "left")
             .select("_key", "_start", "_lstart", "_cells", F.explode(F.sequence(
                 F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("_n") - 1) / block))).alias("_salt")))
    rows = placed.withColumn("_salt", F.floor(F.col("_pos") / block)).join(known, ["_key", "_salt"])

    within = F.col("_pos") - F.col("_start")
    cell = F.filter("_cells", lambda x: within < x["before"] + x["c"])[0]
    needs = list(accumulate((quota[s] - load[s] for s in range(shards)), initial=0))
    alone = F.col("_start") - F.col("_lstart")
    lone = F.size(F.filter(F.array(*[F.lit(int(v)) for v in needs[1:]]), lambda x: x <= alone))
    shard = F.when(F.col("_cells").isNull(), lone).otherwise(cell["s"]).cast("int")
    slot = F.when(F.col("_cells").isNull(), alone - _numbers(needs, lone) + _numbers([*load, 0], lone)).otherwise(
        cell["base"] + within - cell["before"]).cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"),
                       slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
