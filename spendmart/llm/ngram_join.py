"""N-gram Jaccard join by a token-group matrix: groups of similar documents store the union of their shingles,
a query's overlap with the union bounds its overlap with every member, and only groups that pass are opened.

Steps, each a distributed job:

1. One pass finds heavy shingles: those that one task sees in at least `heavy_share` of its documents. Whatever
   is held by that share of all documents is held by it in some task, and a task can list at most
   (mean set size / heavy_share) of them, so the merged list is bounded whatever the corpus size.
2. A second pass orders each set by (heavy count, hash) and keeps a prefix: all but the needed overlap, plus a
   twentieth. Two linked sets share at least that twentieth of the smaller one within their prefixes. Equal sets are
   one class. Prefix tokens travel in arrays by hash slot, one posting per task and token; tokens held by one set only
   vanish there, and so do sets left with too few shared tokens to link with anything. A token known to be shared (a
   heavy one, or one that a task meets twice) needs no such meeting: its holders travel as rows, spread by document.
3. Every remaining set picks a leader, the best-connected set among its tokens' holders. Groups are leaders with their
   followers, split in blocks of bounded size. A set is a query to every group whose union of prefix tokens holds enough
   of its own.
4. A unit of work is one block against one block of queries. Inside, the matrix of tokens by small groups gives
   the bound; groups that pass are opened and compared exactly. In a group of several blocks every block meets the leader
   first: sets linked to it are joined through it and need no comparison with each other, and only the others go on as
   queries to all blocks. A unit reports at most one link per set, enough for the components.
5. Components of the links, then of all documents through their class.

No pair is ever emitted for a shared token alone, copies are never expanded, and no list of partners is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendmart.llm import textbytes as tb
from spendmart.llm.components import connected_components
from spendmart.llm.shared import materialize, scratch

HEAVY_SHARE = 0.001
HEAVY_LIMIT = 2_000_000  # entries; only the order of tokens depends on them, never a result
SLOT_BYTES = 8 << 20  # text per hash slot
BLOCK_TOKENS = 200_000
GROUP_SETS = 32
_ROWS = 256  # rows per chunk, so that a row number and 56 bits of hash share one sortable word
_MASK = np.uint64((1 << 56) - 1)
_PASS = "kind int, slot long, doc_id long, n long, set1 long, set2 long, score double, tokens binary, docs binary"
_KEPT = "kind int, doc_id long, n long, set1 long, set2 long, score double, token long"


def _sets(chunk: tb.Chunk, width: int):
    """(row, token) of every distinct shingle, sorted; tokens are 56-bit hashes."""
    rows, hashes = tb.shingles(tb.words(chunk, lower=True), width)
    packed = np.sort((rows.astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8)))
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    return (packed >> np.uint64(56)).astype(np.int64), packed & _MASK


def _heavy(width: int, share: float):
    def run(batches):
        held, docs = [], 0
        for batch in batches:
            for chunk in tb.chunks(batch.column("text"), rows=_ROWS):
                docs += chunk.last - chunk.first
                held.append(_sets(chunk, width)[1])
                if sum(map(len, held)) > 2_000_000:
                    yield from _counted(held, docs, share)
                    held, docs = [], 0
        yield from _counted(held, docs, share)

    return run


def _counted(held: list, docs: int, share: float):
    if held:
        tokens = np.sort(np.concatenate(held))
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(tokens)))
        keep = counts >= max(2, share * docs)
        yield pa.RecordBatch.from_arrays([pa.array(tb.signed(tokens[starts[keep]])), pa.array(counts[keep])], names=["token", "held"])


def heavy_tokens(docs: DataFrame, width: int, share: float = HEAVY_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens and counts; bounded, see the module text."""
    found = docs.select("text").filter("text IS NOT NULL").mapInArrow(_heavy(width, share), "token long, held long")
    top = found.groupBy("token").agg(F.sum("held").alias("held")).orderBy(F.desc("held"), "token").limit(HEAVY_LIMIT).toArrow()
    tokens = top.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top.column("held").to_numpy()[order]


def _needed(n, percent: int):
    """Smallest overlap of a set of n with any set it links to."""
    return -(-n * percent // 100)


def _shared_at_least(n):
    """Prefix tokens that a set of n shares with any other set of n tokens or more that it links to."""
    return 1 + n // 20


def _prefixes(width: int, percent: int, slots: int, heavy):
    def run(batches):
        tokens, counts = heavy.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            heads: dict[str, list] = {k: [] for k in ("doc", "n", "set1", "set2", "score")}
            posted, holders, hot = [], [], []
            for chunk in tb.chunks(batch.column("text"), rows=_ROWS):
                rows, found = _sets(chunk, width)
                n_rows = chunk.last - chunk.first
                n = np.bincount(rows, minlength=n_rows)
                first = np.cumsum(n) - n
                full = np.flatnonzero(n)
                set1, set2 = np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)
                weight = np.zeros(len(found), np.int64)
                if len(found):
                    set1[full] = tb.mix(np.add.reduceat(tb.mix(found), first[full]))
                    set2[full] = np.add.reduceat(tb.mix(found ^ np.uint64(0x5851F42D4C957F2D)), first[full])
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
                        weight = np.where(tokens[at] == found, counts[at], 0)
                score = np.bincount(rows, weights=np.log1p(weight), minlength=n_rows) / np.maximum(n, 1)
                order = np.lexsort((found, weight, rows))
                prefix = np.minimum(n, n - _needed(n, percent) + _shared_at_least(n))
                # so small that only an equal set could link, which is the same class; an empty set is one of them
                prefix[(_needed(n, percent) == n) & (n * 100 // percent == n)] = 0
                take = order[tb.ragged(first, prefix)]
                posted.append(found[take])
                hot.append(weight[take] > 0)
                holders.append(np.repeat(np.arange(chunk.first, chunk.last), prefix))
                for k, v in (("doc", ids[chunk.first : chunk.last]), ("n", n), ("set1", set1), ("set2", set2), ("score", score)):
                    heads[k].append(v)
            if not heads["doc"]:
                continue
            doc, n, set1, set2, score = (np.concatenate(v) for v in heads.values())
            yield _pass_rows(doc, n, set1, set2, score, np.concatenate(posted), np.concatenate(holders), np.concatenate(hot), slots)

    return run


def _pass_rows(doc, n, set1, set2, score, token, holder, hot, slots: int) -> pa.RecordBatch:
    """Heads of all documents (kind 0), tokens known to be shared (kind 2), one posting per other token for each slot (kind 1).

    Rows of kinds 0 and 2 only pass through a slot, so they are dealt by document: no token gathers its holders in one.
    """
    _, least, inverse = np.unique(np.stack([set1, set2]), axis=1, return_index=True, return_inverse=True)
    inverse = inverse.reshape(-1)
    best = np.lexsort((doc, inverse))
    lead = best[np.concatenate([[True], inverse[best][1:] != inverse[best][:-1]])]
    once = np.zeros(len(doc), bool)
    once[lead] = True
    mine = once[holder]
    hot_token, hot_doc = token[mine & hot], doc[holder[mine & hot]]
    token, holder = token[mine & ~hot], holder[mine & ~hot]
    slot = (tb.mix(token) % np.uint64(slots)).astype(np.int64)
    order = np.lexsort((token, slot))
    token, holder, slot = token[order], holder[order], slot[order]
    new = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(new), len(token)))
    shared = np.repeat(size > 1, size)
    one_token, one_doc, one_slot = tb.signed(token[new]), doc[holder[new]], slot[new]
    edge = np.flatnonzero(np.concatenate([[True], one_slot[1:] != one_slot[:-1]])) if len(one_slot) else np.zeros(0, np.int64)
    stop = np.append(edge[1:], len(one_slot))
    sure_token, sure_doc = np.concatenate([hot_token, token[shared]]), np.concatenate([hot_doc, doc[holder[shared]]])
    heads, twice, parts = len(doc), len(sure_doc), len(edge)
    none = lambda k: [None] * k
    seen = (size > 1).astype(np.uint8)  # out already, as rows of kind 2
    longs = lambda *v: pa.array(np.concatenate(v), pa.int64())
    filler = np.zeros(twice + parts, np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat([0, 2, 1], [heads, twice, parts]).astype(np.int32)),
        longs(np.abs(doc) % slots, np.abs(sure_doc) % slots, one_slot[edge]),
        longs(doc, sure_doc, filler[:parts]),
        longs(n, filler),
        longs(tb.signed(set1), tb.signed(sure_token), filler[:parts]),
        longs(tb.signed(set2), filler),
        pa.array(np.concatenate([score, np.zeros(twice + parts)])),
        pa.array(none(heads + twice) + [one_token[a:b].tobytes() for a, b in zip(edge, stop, strict=True)], pa.binary()),
        pa.array(none(heads + twice) + [one_doc[a:b].tobytes() + seen[a:b].tobytes() for a, b in zip(edge, stop, strict=True)], pa.binary()),
    ], names=[f.split()[0] for f in _PASS.split(", ")])


def _meet(table: pa.Table) -> pa.Table:
    """One slot: heads pass, tokens that several sets hold come out as one row per holder."""
    kind = table.column("kind").to_numpy()
    plain = table.filter(pa.array(kind != 1))
    parts = table.filter(pa.array(kind == 1))
    packed = parts.column("docs").to_pylist()
    token = np.frombuffer(b"".join(parts.column("tokens").to_pylist()), np.int64)
    holder = np.frombuffer(b"".join(x[: len(x) // 9 * 8] for x in packed), np.int64)
    seen = np.frombuffer(b"".join(x[len(x) // 9 * 8 :] for x in packed), np.uint8)
    order = np.argsort(token, kind="stable")
    token, holder, seen = token[order], holder[order], seen[order]
    new = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    size = np.diff(np.append(np.flatnonzero(new), len(token)))
    out = np.repeat(size > 1, size) & (seen == 0)
    is_head = plain.column("kind").to_numpy() == 0
    k = int(out.sum())
    zeros = np.zeros(k, np.int64)
    take = lambda c: plain.column(c).to_numpy()
    return pa.table({
        "kind": pa.array(np.concatenate([np.where(is_head, 0, 1), np.ones(k)]).astype(np.int32)),
        "doc_id": pa.array(np.concatenate([take("doc_id"), holder[out]])),
        "n": pa.array(np.concatenate([take("n"), zeros])),
        "set1": pa.array(np.concatenate([np.where(is_head, take("set1"), 0), zeros])),
        "set2": pa.array(np.concatenate([take("set2"), zeros])),
        "score": pa.array(np.concatenate([take("score"), np.zeros(k)])),
        "token": pa.array(np.concatenate([np.where(is_head, 0, take("set1")), token[out]])),
    })


def _sizes(width: int):
    def run(batches):
        for batch in batches:
            for chunk in tb.chunks(batch.column("text"), rows=_ROWS):
                n = np.bincount(_sets(chunk, width)[0], minlength=chunk.last - chunk.first)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

    return run


def _packed(width: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for chunk in tb.chunks(batch.column("text"), rows=_ROWS):
                rows, found = _sets(chunk, width)
                ends = np.searchsorted(rows, np.arange(chunk.last - chunk.first), side="right")
                starts = np.append(0, ends[:-1])
                values = [found[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[chunk.first : chunk.last]), pa.array(values, pa.binary())], names=["doc_id", "tokens"])

    return run


class _Links:
    """Union-find over the sets of one unit; a pair is reported only if it joins two parts."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.pairs: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.pairs.append((a, b))


def _linked(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def _compare(ids, sets, others, other_sets, links: _Links, percent: int) -> None:
    """Every set of `others` against the groups of `sets`."""
    if not ids or not others:
        return
    sizes = np.array([len(s) for s in sets])
    # near sets side by side: by their smallest uncommon token, then size
    flat = np.concatenate(sets)
    vocabulary, where, held = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    rare = np.lexsort((where, held[where], owner))
    first = np.cumsum(sizes) - sizes
    order = np.lexsort((sizes, where[rare[first]]))
    rank = np.empty(len(sets), np.int64)
    rank[order] = np.arange(len(sets))
    group = rank // GROUP_SETS
    n_groups = int(group.max()) + 1
    matrix = np.zeros((len(vocabulary), n_groups), bool)
    matrix[where, group[owner]] = True
    low = np.full(n_groups, np.iinfo(np.int64).max)
    np.minimum.at(low, group, sizes)
    by_group = np.argsort(group[owner], kind="stable")
    edges = np.searchsorted(group[owner][by_group], np.arange(n_groups + 1))
    members = [np.flatnonzero(group == g) for g in range(n_groups)]
    chosen = np.zeros(len(vocabulary), bool)
    for q, mine in zip(others, other_sets, strict=True):
        at = np.minimum(np.searchsorted(vocabulary, mine), len(vocabulary) - 1)
        at = at[vocabulary[at] == mine]
        if not len(at):
            continue
        bound = matrix[at].sum(axis=0)
        reach = (100 + percent) * bound >= percent * (len(mine) + np.maximum(low, _needed(len(mine), percent)))
        chosen[at] = True
        for g in np.flatnonzero(reach):
            root = links.root(q)
            if all(links.root(ids[m]) == root for m in members[g]):
                continue
            opened = by_group[edges[g] : edges[g + 1]]
            hit = chosen[where[opened]]
            overlap = np.bincount(owner[opened[hit]], minlength=len(sets))[members[g]]
            for m in members[g][_linked(overlap, len(mine), sizes[members[g]], percent)]:
                links.link(q, ids[m])
        chosen[at] = False


def _pairs(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([a for a, _ in pairs], pa.int64()), "v": pa.array([b for _, b in pairs], pa.int64())})


def _unit(percent: int):
    """A block (role 1) against queries (role 2); chunk 0 is a block against itself."""

    def run(table: pa.Table) -> pa.Table:
        links = _Links()
        sides: dict[int, tuple[list, list]] = {1: ([], []), 2: ([], [])}
        for role, doc, tokens in zip(table.column("role").to_pylist(), table.column("doc_id").to_pylist(), table.column("tokens").to_pylist(), strict=True):
            sides[role][0].append(doc)
            sides[role][1].append(np.frombuffer(tokens, np.uint64))
        inside = table.column("unit")[0].as_py()["c"] == 0
        if not inside or len(sides[1][0]) > 1:
            _compare(*sides[1], *sides[1 if inside else 2], links, percent)
        return _pairs(links.pairs)

    return run


def _to_leader(percent: int):
    """Links of one block's sets (role 1) with the leader of their group (role 0)."""

    def run(table: pa.Table) -> pa.Table:
        role, doc = table.column("role").to_numpy(), table.column("doc_id").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        pairs = []
        for lead in np.flatnonzero(role == 0):
            for at in np.flatnonzero(role == 1):
                overlap = len(np.intersect1d(sets[at], sets[lead], assume_unique=True))
                if doc[at] != doc[lead] and _linked(overlap, len(sets[at]), len(sets[lead]), percent):
                    pairs.append((doc[at], doc[lead]))
        return _pairs(pairs)

    return run


def _least_shared(percent: int):
    """Column form: what a set of n must share with a set it links to, which may be smaller."""
    return F.expr(f"1 + ((n * {percent} + 99) div 100) div 20")


def _enough(held: DataFrame, percent: int) -> DataFrame:
    """(token, doc_id, n, score) without tokens of one holder, and without sets left with too few tokens."""
    with scratch(held.sparkSession) as keep:
        several = materialize(held.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token"), "several")
        held = materialize(held.join(several, "token"), "shared")
        full = held.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= _least_shared(percent)).select("doc_id")
        return keep(held.join(materialize(full, "full"), "doc_id"), "shared")


def _group_links(sets: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(u, v): enough links for the components, from groups around leaders."""
    tops = shared.groupBy("token").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("minus"))).alias("top"))
    tops = materialize(tops.select("token", "top"), "tops")
    leads = shared.join(tops, "token").groupBy("doc_id", "n").agg(F.max("top").alias("top"))
    leads = materialize(leads.select("doc_id", "n", (-F.col("top.minus")).alias("leader")), "leads")
    held = materialize(shared.select("token", "doc_id").join(leads.select("doc_id", "leader"), "doc_id"), "held")
    apart = held.groupBy("token").agg(F.min("leader").alias("a"), F.max("leader").alias("b")).filter("a < b").select("token")
    apart = materialize(apart, "apart")
    mixed = materialize(held.join(apart, "token"), "mixed")
    meets = materialize(mixed.select("token", F.col("leader").alias("other")).distinct(), "meets")
    foreign = mixed.join(meets, "token").filter("leader < other").groupBy("doc_id", F.col("other").alias("leader")).agg(F.count(F.lit(1)).alias("k"))
    foreign = foreign.join(leads.select("doc_id", "n"), "doc_id").filter(F.col("k") >= _least_shared(percent)).select("doc_id", "leader", "n")
    foreign = materialize(foreign, "foreign")
    parts = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK_TOKENS)).cast("int")
    spread = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    blocks = materialize(leads.groupBy("leader").agg(parts(F.sum("n")).alias("blocks")), "group-sizes")
    own = leads.join(blocks, "leader").withColumn("b", spread(F.col("blocks")))
    links, large = [], blocks.filter("blocks > 1")
    if not large.isEmpty():
        mine = own.filter("blocks > 1").select("doc_id", F.struct("leader", "b").alias("unit"), F.lit(1).alias("role"))
        led = large.select(F.col("leader").alias("doc_id"), F.explode(_numbers("blocks", lambda b: F.struct("leader", b.alias("b")))).alias("unit"), F.lit(0).alias("role"))
        met = mine.unionByName(led).join(sets, "doc_id").groupBy("unit").applyInArrow(_to_leader(percent), "u long, v long")
        met = materialize(met, "leader-links")
        links.append(met)
        joined = met.select(F.col("u").alias("doc_id"), F.col("v").alias("leader"))
        rest = own.filter("blocks > 1 AND doc_id <> leader").join(joined, ["doc_id", "leader"], "left_anti")
        foreign = materialize(foreign.unionByName(rest.select("doc_id", "leader", "n")), "queries")
    asked = foreign.groupBy("leader").agg(parts(F.sum("n")).alias("chunks"))
    sizes = materialize(blocks.join(asked, "leader", "left").select("leader", "blocks", F.coalesce("chunks", F.lit(0)).alias("chunks")), "unit-sizes")
    unit = lambda b, c: F.struct("leader", b.alias("b"), c.alias("c"))
    # chunk 0: the one block of a group against itself
    first = F.when(F.col("blocks") == 1, 0).otherwise(1)
    placed = own.drop("blocks").join(sizes, "leader").filter(F.col("chunks") >= first)
    placed = placed.select("doc_id", F.explode(F.transform(F.sequence(first, F.col("chunks")), lambda c: unit(F.col("b"), c))).alias("unit"), F.lit(1).alias("role"))
    queries = foreign.join(sizes, "leader").withColumn("c", 1 + spread(F.col("chunks")))
    queries = queries.select("doc_id", F.explode(_numbers("blocks", lambda b: unit(b, F.col("c")))).alias("unit"), F.lit(2).alias("role"))
    links.append(placed.unionByName(queries).join(sets, "doc_id").groupBy("unit").applyInArrow(_unit(percent), "u long, v long"))
    return links[0] if len(links) == 1 else links[0].unionByName(links[1])


def _numbers(count: str, build):
    return F.transform(F.sequence(F.lit(0), F.col(count) - 1), build)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Words are what stands between ASCII blanks, A-Z lower-cased; a text with fewer words than `width` has its whole
    sequence as one shingle; null, empty and blank texts have no set and link with nothing. Documents link when
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable. Rows that share an id
    are one node. A null id gets a null component.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_components(docs, width, percent), "near-duplicates")


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    known = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    volume = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(1, volume // SLOT_BYTES)
    heavy = spark.sparkContext.broadcast(heavy_tokens(known, width))
    passed = known.mapInArrow(_prefixes(width, percent, slots, heavy), _PASS).groupBy("slot").applyInArrow(_meet, _KEPT)
    passed = materialize(passed, "prefixes")
    heads = passed.filter("kind = 0").select("doc_id", "n", "set1", "set2", "score")
    classes = materialize(heads.filter("n > 0").groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"), F.max("score").alias("score"), F.max("n").alias("n")), "classes")
    holders = passed.filter("kind = 1").select("token", "doc_id").distinct()
    holders = materialize(holders.join(classes.select(F.col("rep").alias("doc_id"), "n", "score").dropDuplicates(["doc_id"]), "doc_id"), "holders")
    shared = _enough(_enough(holders, percent), percent)
    needed = shared.select("doc_id").distinct()
    sets = known.filter("text IS NOT NULL").join(needed, "doc_id").withColumn("fp", F.xxhash64("text")).dropDuplicates(["doc_id", "fp"]).select("doc_id", "text").mapInArrow(_packed(width), "doc_id long, tokens binary")
    sets = materialize(sets, "sets")
    links = _group_links(sets, shared, percent)
    # texts that share an id connect their classes
    many = materialize(heads.filter("n > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id"), "many")
    same = heads.join(many, "doc_id").join(classes.select("set1", "set2", "rep"), ["set1", "set2"])
    links = links.unionByName(same.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    found = materialize(connected_components(links), "components")
    tied = classes.join(found, classes.rep == found.id, "left").select("set1", "set2", F.coalesce("component", "rep").alias("component"))
    tied = materialize(tied, "class-components")
    own = heads.filter("n > 0").join(tied, ["set1", "set2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    bare = heads.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    unnamed = docs.filter("doc_id IS NULL").select("text").mapInArrow(_sizes(width), "n long")
    unnamed = unnamed.select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return own.unionByName(bare).unionByName(unnamed)
