"""Jaccard self-join of word n-gram sets, by prefixes with token combinations.

Any order of the shingles works; here rarer ones come first. A set of n shingles that links with another shares j
shingles with it within its first n - ceil(t n) + j. Within that prefix rare shingles are indexed alone. Where frequent
ones reach into it, it is extended by m, frequent shingles fall into m groups by hash, and two of the m + 1 shared ones
fall into one group: pairs within a group are indexed.

The index is built twice. Over all sets, prefixes are extended so that a set that links shows several signatures that
others have too; sets that do not are done. Over the others, shingles are counted one by one; those with too few shared
shingles are done, and the rest are indexed under their rarest shingles. Candidates of that index are verified.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bounded, forget, written
from .words import WordHashes, mixed, shingle_hashes, split_words

#: Shingles of a corpus share 2**COUNTER_BITS counters (as many whatever the corpus, so that what tasks send grows with
#: their number alone); shingles whose counter is FREQUENT times the mean, and FREQUENT_COUNT at least, are frequent.
COUNTER_BITS, FREQUENT, FREQUENT_COUNT = 17, 8, 4096
#: Buckets of the histograms by which hopeless candidates are told.
HISTOGRAM = 256


@dataclass(frozen=True)
class JaccardRule:
    """Link when den * |x & y| >= num * |x | y|, for sets of n consecutive words."""

    words: int = 4
    num: int = 85
    den: int = 100

    def shingles(self, text: str | None, hashes: WordHashes) -> np.ndarray:
        """The set of a text, sorted; a shorter text is one shingle, a text without words none."""
        words = hashes.of(split_words(text))
        if 0 < len(words) < self.words:
            return shingle_hashes(words, len(words)) ^ np.uint64(len(words))
        return np.unique(shingle_hashes(words, self.words))

    def overlap(self, n: int) -> int:
        """What a set of n shares with any partner at least."""
        return -(-self.num * n // self.den)

    def alone(self, n: int) -> bool:
        """Whether a set of n links with equal sets only."""
        return self.overlap(n) == n == n * self.den // self.num

    def extension(self, n: int) -> int:
        """By how much the first index extends the prefix of a set of n."""
        return (n - self.overlap(n) + 1) // 4

    def shown(self, n: int) -> int:
        """How many shared signatures a set of n that links shows at least: a smaller partner extends its prefix less."""
        return self.extension(self.overlap(n)) + 1

    def needed(self) -> str:
        """SQL over sizes na and nb: the intersection of linked sets at least."""
        both = self.num + self.den
        return f"(({self.num} * (na + nb) + {both - 1}) div {both})"

    def possible(self) -> str:
        """SQL over sizes: whether sets of na and nb can link at all."""
        return f"{self.den} * least(na, nb) >= {self.num} * greatest(na, nb)"


def set_name(shingles: np.ndarray) -> int | None:
    """A 64-bit name of a sorted set, none if it is empty."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


def groups_of_frequent(n: int, rule: JaccardRule) -> list[tuple[int, int]]:
    """(level, m) by which a set of n indexes frequent shingles: the levels that some partner's size falls into."""
    low, high = rule.overlap(n), n * rule.den // rule.num
    return [(level, max(1, (1 << level) * (rule.den - rule.num) // (8 * rule.den))) for level in range(low.bit_length() - 1, high.bit_length())]


def classes_of(shingles: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return classes[(shingles >> np.uint64(64 - int(len(classes)).bit_length() + 1)).astype(np.int64)]


def signatures(first: np.ndarray, kinds: np.ndarray, frequent: int, n: int, rule: JaccardRule, more: int, private: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """The hashes under which a set of n is indexed, and the places of its shingles in its order; no places if frequent
    shingles reach into its prefix, which is extended by `more`. first and kinds: its shingles and their classes in that
    order, behind `private` ones that no other set has."""
    prefix = n - rule.overlap(n) + 1
    length = prefix + more - private
    if length <= len(first) and (length <= 0 or kinds[length - 1] < frequent):
        return mixed(first[: max(length, 0)]), np.arange(private, private + max(length, 0))
    groups = groups_of_frequent(n, rule)
    length = max(length, prefix + max(m for _, m in groups) - private)
    out = [mixed(first[:length][kinds[:length] < frequent])]
    with np.errstate(over="ignore"):
        for level, m in groups:
            often = first[: prefix + m - private][kinds[: prefix + m - private] >= frequent]
            group = mixed(often) % np.uint64(m)
            for g in np.unique(group).tolist():
                x = np.sort(often[group == g])
                a, b = np.triu_indices(len(x), 1)
                out.append(mixed(mixed(x[a]) * np.uint64(3) + mixed(x[b]) + np.uint64(level)))
    return np.unique(np.concatenate(out)), None


def read_sets(docs: DataFrame, rule: JaccardRule, bits: int) -> tuple[DataFrame, DataFrame]:
    """One pass over all texts (id, text): (id, n, node) for every document, node being a name of its set (null if
    empty); and (counter, n), how many shingles of all sets fall to each counter."""

    def read(batches):
        hashes, counts = WordHashes(), np.zeros(1 << bits, np.int64)
        for batch in batches:
            sizes, nodes, pending = [], [], []
            for text in batch.column(1):
                s = rule.shingles(text.as_py(), hashes)
                sizes.append(len(s))
                nodes.append(set_name(s))
                pending.append(s)
                if len(pending) == 512:
                    counts += np.bincount((np.concatenate(pending) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                    pending = []
            counts += np.bincount((np.concatenate([*pending, np.empty(0, np.uint64)]) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            none = pa.nulls(len(sizes), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), none], ["id", "n", "node", "counter"])
        at = np.flatnonzero(counts)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(counts[at]), none, pa.array(at.astype(np.int32))], ["id", "n", "node", "counter"])

    both = written(docs.mapInArrow(read, "id long, n long, node long, counter int").withColumn("kind", F.col("counter").isNotNull().cast("int")), "join-sets", ("kind",))
    return both.where("kind = 0").select("id", "n", "node"), both.where("kind = 1").groupBy("counter").agg(F.sum("n").alias("n"))


def frequency_classes(counters: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """A byte for each counter, twice the binary logarithm of its count, and the class from which shingles are frequent."""
    table = counters.toArrow()
    counts = np.zeros(1 << bits)
    counts[table["counter"].to_numpy()] = table["n"].to_numpy()
    classes = np.floor(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
    return classes, int(np.ceil(2 * np.log2(max(FREQUENT_COUNT, FREQUENT * counts.mean()))))


def showing_enough(docs: DataFrame, rule: JaccardRule, classes: np.ndarray, frequent_class: int) -> DataFrame:
    """(node) of the sets of column text that show as many shared signatures as a set that links has to.

    Signatures are dealt out by ranges of signature and set, so a very common one spreads over tasks; where a range
    ends, its last signature counts as shared even if it is alone."""
    sent = docs.sparkSession.sparkContext.broadcast((classes, frequent_class))

    def emit(batches):
        hashes, (classes, frequent) = WordHashes(), sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                sig, node, least = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
                for text in batch.column(0).slice(k, 1024):
                    s = rule.shingles(text.as_py(), hashes)
                    if len(s) and not rule.alone(len(s)):
                        c = classes_of(s, classes)
                        order = np.lexsort((s, c))
                        found, plain = signatures(s[order], c[order], frequent, len(s), rule, rule.extension(len(s)))
                        sig.append(found)
                        node.append(np.full(len(found), set_name(s), np.int64))
                        least.append(np.full(len(found), 1 if plain is None else rule.shown(len(s)), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(node)), pa.array(np.concatenate(least))], ["sig", "node", "least"])

    def shared(batches):
        last = None  # signature, set and least of the row before the batch, and whether its signature is shared
        row = lambda node, least: pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(least, pa.int32())], ["node", "least"])
        for batch in batches:
            sig, node, least = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(sig):
                continue
            same = np.concatenate(([last is None or last[0] == sig[0]], sig[1:] == sig[:-1]))
            if last is not None and (last[3] or same[0]):
                yield row([last[1]], [last[2]])
            both = same.copy()
            both[:-1] |= same[1:]
            yield row(node[:-1][both[:-1]], least[:-1][both[:-1]])
            last = (sig[-1], node[-1], least[-1], bool(same[-1]))
        if last is not None:
            yield row([last[1]], [last[2]])

    all_ = written(docs.select("text").mapInArrow(emit, "sig long, node long, least int"), "join-signatures")
    met = all_.repartitionByRange("sig", "node").sortWithinPartitions("sig", "node").mapInArrow(shared, "node long, least int")
    able = written(met.groupBy("node", "least").count().where("count >= least").select("node").distinct(), "join-able")
    forget(all_)
    return able


def shared_shingles(sets: DataFrame) -> DataFrame:
    """(node, n, tokens, counts, usual) from sets (node, n, least, shingles): the shingles that several of the sets
    have, rarest first, and in how many; only sets with `least` of them. usual: how common its shingles are."""
    each = sets.select("node", "n", "least", F.explode("shingles").alias("token"))
    met = each.withColumn("count", F.count(F.lit(1)).over(W.partitionBy("token")).cast("int")).where("count > 1")
    ranked = met.groupBy("node", "n", "least").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("t")).where("size(t) >= least")
    return ranked.select("node", "n", F.col("t.token").alias("tokens"), F.col("t.count").alias("counts"), (F.aggregate("t", F.lit(0.0), lambda s, t: s + t["count"]) / F.col("n")).alias("usual"))


def index_sets(sets: DataFrame, rule: JaccardRule, frequent: int) -> DataFrame:
    """(sig, node, n, at) from (node, n, tokens, counts): at is the place of the shingle in its set's order, 0 for
    combinations and for sets that have frequent shingles in their prefix."""

    def emit(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                sig, node, size, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
                for name, n, tokens, counts in zip(*(batch.column(c).slice(k, 256) for c in range(4)), strict=True):
                    n = n.as_py()
                    found, places = signatures(tokens.values.to_numpy().view(np.uint64), counts.values.to_numpy(), frequent, n, rule, 0, n - len(tokens))
                    sig.append(found)
                    node.append(np.full(len(found), name.as_py(), np.int64))
                    size.append(np.full(len(found), n, np.int32))
                    at.append(np.zeros(len(found), np.int32) if places is None else places.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (node, size, at))], ["sig", "node", "n", "at"])

    return sets.select("node", "n", "tokens", "counts").mapInArrow(emit, "sig long, node long, n int, at int")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def verify(pairs: DataFrame, sets: DataFrame, rule: JaccardRule) -> DataFrame:
    """The pairs (a, b) whose sets link. Histograms of both sets bound the intersection from above; what they do not sort
    out, mostly real links, is compared by the sets themselves."""

    def histogram(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                node, n, tokens = (batch.column(c).slice(k, 1024) for c in range(3))
                counts = [np.minimum(np.bincount(x.values.to_numpy().view(np.uint64).astype(np.int64) & (HISTOGRAM - 1), minlength=HISTOGRAM), 255).astype(np.uint8).tobytes() for x in tokens]
                lost = [max(0, len(x) - sum(h)) for x, h in zip(tokens, counts, strict=True)]  # beyond 255 in a bucket
                yield pa.RecordBatch.from_arrays([node, n, pa.array(counts, pa.binary()), pa.array(lost, pa.int32())], ["node", "n", "h", "lost"])

    def hopeful(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                ha, hb = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, HISTOGRAM) for c in (4, 5))
                na, nb, lost = (part.column(c).to_numpy().astype(np.int64) for c in (2, 3, 6))
                most = np.minimum(ha, hb).sum(axis=1, dtype=np.int64) + lost
                keep = np.flatnonzero((rule.num + rule.den) * most >= rule.num * (na + nb))
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(keep)) for c in range(4)], ["a", "b", "na", "nb"])

    sketches = sets.select("node", "n", "tokens").mapInArrow(histogram, "node long, n int, h binary, lost int")
    a, b = (sketches.select(*(F.col(c).alias(f"{c}{x}") for c in ("node", "n", "h", "lost"))) for x in "ab")
    met = pairs.join(a, F.col("a") == F.col("nodea")).join(b, F.col("b") == F.col("nodeb")).where(rule.possible())
    maybe = written(met.select("a", "b", "na", "nb", "ha", "hb", F.least("losta", "lostb").alias("lost")).mapInArrow(hopeful, "a long, b long, na int, nb int"), "join-hopeful")
    left, right = (sets.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    compared = maybe.join(left, "a").join(right, "b").where(f"size(array_intersect(ta, tb)) >= {rule.needed()}")
    return compared.select("a", "b")


def hubs_of(index: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Under every signature the set with the most usual shingles is the hub: (x, y) for sets and hubs they meet, and
    (node, hub) for the one that a set meets most often. Edits of their own make copies less usual than what they copy."""
    stars = index.join(sets.select("node", "usual"), "node").groupBy("sig").agg(F.max(F.struct("usual", "node")).alias("hub"))
    met = index.select("sig", "node").join(stars.select("sig", F.col("hub.node").alias("hub")), "sig").groupBy("node", "hub").count()
    met = written(met, "join-stars")
    first = met.groupBy("node").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    again = first.select(F.col("node").alias("hub"), F.col("hub").alias("own"))
    homes = written(first.join(again, "hub").select("node", F.col("own").alias("hub")), "join-homes")
    return met.select(F.col("node").alias("x"), F.col("hub").alias("y")), homes


def apart(placed: DataFrame, index: DataFrame, rule: JaccardRule) -> DataFrame:
    """(x, y) of sets with different hubs and roots that can link by the place of a shingle in both prefixes."""
    rows = index.join(placed.select("node", "hub", "root"), "node")
    spread = rows.groupBy("sig").agg(F.min("hub").alias("h1"), F.max("hub").alias("h2"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("h1 < h2 AND r1 < r2")
    rows = written(rows.join(spread.select("sig"), "sig", "left_semi"), "join-apart")
    a, b = (rows.select("sig", *(F.col(c).alias(f"{c}{x}") for c in ("node", "hub", "root", "n", "at"))) for x in "ab")
    near = a.join(b, "sig").where("nodea < nodeb AND huba <> hubb AND roota <> rootb").where(rule.possible())
    return near.where(f"ata <= na - {rule.needed()} AND atb <= nb - {rule.needed()}").select(F.col("nodea").alias("x"), F.col("nodeb").alias("y"))


def around_hubs(placed: DataFrame, sets: DataFrame, links: DataFrame, rule: JaccardRule) -> DataFrame:
    """(x, y) of sets with the same hub and different roots that can link by what tells them from their hub.

    Let dx be the size of the symmetric difference of x and the hub. x and y link only if at least (dx + dy - d) / 2
    shingles tell both from it, d being the most by which linked sets of their sizes differ. Where one of them does not
    link with the hub that is more than share * max(dx, dy) for those that do not, num / (num + den) being the share, and
    never below 1: so the differences are joined by prefixes as sets are. Copies with edits of their own have few
    differences in common, however many they are. First come the private shingles of x, which no other set has, then its
    other shingles that the hub lacks, then what it lacks, what most others have first.
    """
    split = placed.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("hub")
    members = placed.join(split, "hub", "left_semi").join(sets.select("node", "n", "tokens"), "node")
    names = F.expr("transform(sequence(1, n - size(tokens)), k -> xxhash64(node, k))")
    core = sets.join(split, F.col("node") == F.col("hub"), "left_semi").select(F.col("node").alias("hub"), F.reverse(F.when(F.expr("n > size(tokens)"), F.concat(names, "tokens")).otherwise(F.col("tokens"))).alias("core"))
    near = links.select(F.col("a").alias("node"), F.col("b").alias("hub")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("hub"))).withColumn("near", F.lit(True))
    told = members.where("node <> hub").join(core, "hub").join(near, ["node", "hub"], "left")
    told = told.withColumn("differ", F.concat(F.array_except("tokens", "core"), F.array_except("core", "tokens"))).withColumn("private", F.expr("n - size(tokens)"))
    told = told.withColumn("d", F.expr("private + size(differ)"))
    last = F.when(F.col("near"), F.expr(f"d - d * {rule.num} div {rule.num + rule.den} - 1")).otherwise(F.col("d") - 1)  # the last place that is of use
    shown = told.withColumn("last", last).where("last >= private").select("hub", "node", "root", "n", "d", "private", F.posexplode(F.expr("slice(differ, 1, cast(last - private + 1 as int))")).alias("k", "token"))
    rows = written(shown.select("hub", "node", "root", "n", "d", F.expr("k + private").alias("at"), "token"), "join-around")
    a, b = (rows.select("hub", "token", *(F.col(c).alias(f"{c}{x}") for c in ("node", "root", "n", "d", "at"))) for x in "ab")
    common = f"((da + db - na - nb + 2 * {rule.needed()} + 1) div 2)"
    met = a.join(b, ["hub", "token"]).where("nodea < nodeb AND roota <> rootb").where(rule.possible())
    return met.where(f"ata <= da - {common} AND atb <= db - {common}").select(F.col("nodea").alias("x"), F.col("nodeb").alias("y"))


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: JaccardRule | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id) for every document; component_id is the smallest id that links reach.

    1. Documents with equal sets are one node. Sets that show too few signatures that others have too, or too few shared
       shingles, link with no other set.
    2. The rest are indexed. Under every signature sets are candidates with one hub, and each set with the hub that it
       meets most often: candidates in proportion to the index. The verified ones give first components.
    3. Sets of different components that have the same hub meet by what tells them from it, those with different hubs by
       their signatures. No link between components is lost, sets that are connected already are not paired, and
       copies of one text with edits of their own do not become candidates merely as they share that text.
    Null and empty texts have no shingles and are alone; a text is held whole by one task at a time, however long. Rows
    that share an id count as that id; null ids are alone in the sense that they never name a component unless it has no
    other id. Sets are compared by 64-bit shingle hashes. Other columns are ignored; an empty table gives no rows.
    """
    rule = rule or JaccardRule()
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    of_doc, counters = read_sets(source, rule, COUNTER_BITS)
    classes, frequent_class = frequency_classes(counters, COUNTER_BITS)

    named = of_doc.where("node IS NOT NULL")
    nodes = written(named.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id")).alias("who"), F.count(F.lit(1)).alias("copies")).select("node", "who.id", "copies"), "join-nodes")
    # one document stands for each node: ids that name no node are left out
    copies = named.join(nodes.where("copies > 1").select("node"), "node", "left_semi").select("id").distinct()
    spare = written(copies.join(nodes.select("id"), "id", "left_anti").where("id IS NOT NULL"), "join-spare")
    standing = source.join(bounded(spare), "id", "left_anti")
    able = showing_enough(standing, rule, classes, frequent_class)

    ids = written(nodes.join(able, "node", "left_semi").select("id").distinct(), "join-members")
    texts = standing.alias("d").join(bounded(ids).alias("m"), F.col("d.id").eqNullSafe(F.col("m.id")), "left_semi")
    found = sets_of(texts, rule)
    # standing rows of one node are several only where ids repeat or are null
    repeated = written(named.join(bounded(spare), "id", "left_anti").groupBy("node").count().where("count > 1").select("node"), "join-repeated")
    if repeated.limit(1).count():
        again = found.join(bounded(repeated), "node", "left_semi").dropDuplicates(["node"])
        found = found.join(bounded(repeated), "node", "left_anti").unionByName(again)
    sets = written(shared_shingles(found), "join-shared")

    index = written(index_sets(sets, rule, FREQUENT_COUNT), "join-index")
    stars, homes = hubs_of(index, sets)
    first = written(ordered(stars.unionByName(homes.select(F.col("node").alias("x"), F.col("hub").alias("y")))), "join-candidates")
    links = written(verify(first, sets, rule), "join-links")
    roots = connected_components(links)

    placed = written(homes.join(roots, "node", "left").select("node", "hub", F.coalesce("root", "node").alias("root")), "join-placed")
    second = ordered(around_hubs(placed, sets, links, rule).unionByName(apart(placed, index, rule)))
    second = written(second.join(first, ["a", "b"], "left_anti"), "join-candidates")
    more = written(verify(second, sets, rule), "join-links")
    ends = [placed.select(F.col("node").alias(x), F.col("root").alias(f"root{x}")) for x in "ab"]
    joined = connected_components(more.join(ends[0], "a").join(ends[1], "b").select(F.col("roota").alias("a"), F.col("rootb").alias("b")))

    whole = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("first"))
    whole = whole.join(joined.select(F.col("node").alias("first"), "root"), "first", "left").select("node", "id", F.coalesce("root", "first").alias("root"))
    names = whole.groupBy("root").agg(F.min("id").alias("component_id"))
    final = whole.join(names, "root").select("node", "component_id")
    return of_doc.join(final, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def sets_of(docs: DataFrame, rule: JaccardRule) -> DataFrame:
    """(node, n, least, shingles) for the sets of column text that can link: a row for each text that has words."""

    def read(batches):
        hashes = WordHashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                sets = [x for t in batch.column(0).slice(k, 256) if len(x := rule.shingles(t.as_py(), hashes))]
                names, sizes = pa.array([set_name(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32())
                least = pa.array([rule.overlap(len(x)) for x in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([names, sizes, least, pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "n", "least", "shingles"])

    return docs.select("text").mapInArrow(read, "node long, n int, least int, shingles array<long>")
