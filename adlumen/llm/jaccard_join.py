"""N-gram Jaccard self-join with a token-group matrix.

Texts are sets of hashed word shingles. Equal sets become one row. Similar sets
are partitioned into groups: sets that agree on a min-hash are compared with a
leader, and those that pass form a group with it. The matrix stores, for each
token, the groups in whose union it occurs. A set then queries the matrix:
the tokens it shares with a group are counted, which bounds its overlap with
any member; only groups with enough of them are opened, the same count is taken
for their members, bits of parity bound how many tokens they differ by, and what is
left is compared exactly.

Two sets that reach the limit share a token among the first quarter (for 75 %)
of each in any one order of tokens, so only these prefixes enter the matrix.
A little longer prefixes hold several shared tokens (``_least_hits``), and that
many have to be counted. The order puts frequent
tokens last; a passage that many texts share is then in no prefix, unless texts
consist of little else. Any order gives the same links; a poor one only opens
more groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlumen.functions.sizing import lookup_side
from adlumen.llm.common import forget, free_names, partitions, stored, text_of
from adlumen.llm.components import components

SHINGLE = 5
PERCENT = 75
PERMUTATIONS = 10
ROUNDS = 1  # of meeting leaders
# One in how many members of a group is asked, turn by turn; the last turn asks all.
SHARES = (32, 1)
# Frequent tokens that are put last in the order; a bound, see _frequent.
FREQUENT = 400_000
LONG = 64  # bytes of a word that are hashed eight at a time
KEPT_WORDS = 10_000  # longer ones of which a task keeps the hash
KEPT_TOKENS = 1_000_000  # of the sets a task keeps while it compares pairs
# Tokens of a task that are counted together when looking for frequent ones.
COUNTED = 3_000_000
# One in how many tokens of a set is looked for beyond the first shared one.
MORE = 24
# Texts and bytes of text that a task looks at together.
TOGETHER, TOGETHER_BYTES = 500, 1 << 20
# Bits of a set's parities: each tells whether an odd number of its tokens fall on it.
PARITIES = 512
# Bits of a token by which a task passes over those that are surely not frequent.
FIRST_BITS = 22
_FACTORS = np.array([xxhash.xxh64_intdigest(b"word", i) | 1 for i in range(64)], np.uint64)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_TURNS = np.array([xxhash.xxh64_intdigest(b"turn", i) | 1 for i in range(PERMUTATIONS)], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _let_go() -> None:
    """Gives back what a task's words took; a worker would keep it through later stages."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()


def _word_codes(words: pa.Array) -> np.ndarray:
    """A hash of each word: eight bytes after the other are mixed in; long ones are hashed alone."""
    words = words.cast(pa.large_binary())
    start, size = np.frombuffer(words.buffers()[1], np.int64)[words.offset:][:len(words)], (
        pc.binary_length(words).to_numpy(zero_copy_only=False))
    data = words.buffers()[2].to_pybytes() + bytes(8)
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    codes = _mix(size.astype(np.uint64) * _FACTORS[0])
    rest = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        rest = rest[size[rest] > at]
        if not len(rest):
            break
        eight = eights[start[rest] + at] & _FIRST[np.minimum(size[rest] - at, 8)]
        codes[rest] = _mix((codes[rest] ^ eight) * _FACTORS[1] + _FACTORS[2])
    for k in np.flatnonzero(size > LONG).tolist():
        if len(_hashes) > KEPT_WORDS:
            _hashes.clear()
        codes[k] = _hashes[words[k].as_py()]
    return codes


def _some(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of a bounded number of rows and, but for a single one, bytes of text."""
    ends = np.cumsum(pc.binary_length(batch.column(texts)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        full = np.searchsorted(ends, TOGETHER_BYTES + (ends[at - 1] if at else 0), "right")
        to = min(at + TOGETHER, max(at + 1, int(full)))
        yield batch.slice(at, to - at)
        at = to


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles, end to end, and how many each text has.

    A text of fewer words has one, of the whole sequence.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, row = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    real = pc.greater(pc.binary_length(words), 0)
    counts = np.bincount(row[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    if not counts.any():
        return np.zeros(0, np.uint64), counts
    codes, ends = _word_codes(words.filter(real)), np.cumsum(counts)
    # Each place is hashed with the words that follow in its text, at most ``size``.
    count = len(codes)
    left = np.repeat(ends, counts) - np.arange(count)
    width = np.minimum(size, np.repeat(counts, counts))
    padded = np.concatenate([codes, np.zeros(size, np.uint64)])
    total = codes * _FACTORS[0]
    for k in range(1, size):
        total = np.where(k < width, _mix(total) + padded[k:k + count] * _FACTORS[k], total) \
            if (counts < size).any() else _mix(total) + padded[k:k + count] * _FACTORS[k]
    whole = left >= width
    tokens = _mix(total + width.astype(np.uint64))[whole]
    sizes = np.maximum(counts - size + 1, np.minimum(counts, 1))
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        tokens[a:b].sort()
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    return tokens[new], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[new],
                                    minlength=len(sizes))


def least_overlap(n, percent: int = PERCENT):
    """Tokens a set of ``n`` must share with any set it links to."""
    return -(-n * percent // 100)


SKETCH = ("id {id}, h bigint, n bigint, s binary, mins array<bigint>, bits array<bigint>, "
          "token bigint, times bigint")


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """Per text its set's size, digest, min-hashes and parities; and tokens seen often in a task."""
    schema = SKETCH.format(id=docs.schema["id"].dataType.simpleString())

    def lists(values: np.ndarray) -> pa.Array:
        count, width = values.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * width, pa.int32()),
                                        values.ravel().view(np.int64))

    def rows(ids, hs, tokens, sizes) -> pa.RecordBatch:
        count, ends = len(sizes), np.cumsum(sizes)
        starts = ends - sizes
        mins = np.zeros((count, PERMUTATIONS), np.uint64)
        if len(tokens):
            for k, turn in enumerate(_TURNS):
                mins[sizes > 0, k] = np.minimum.reduceat(tokens * turn, starts[sizes > 0])
        fallen = np.bincount(np.repeat(np.arange(count) * PARITIES, sizes)
                             + (tokens % np.uint64(PARITIES)).astype(np.int64),
                             minlength=count * PARITIES) & 1
        bits = np.packbits(fallen.astype(np.uint8)).view(np.int64).reshape(count, PARITIES // 64)
        return pa.RecordBatch.from_arrays([
            ids, hs, pa.array(sizes.astype(np.int64)),
            pa.array([hashlib.blake2b(tokens[a:b], digest_size=16).digest()
                      for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
            lists(mins), lists(bits), pa.nulls(count, pa.int64()), pa.nulls(count, pa.int64()),
        ], names=NAMES)

    def often(sets: list[np.ndarray], arrow_id: pa.DataType) -> pa.RecordBatch:
        met = np.concatenate(sets)
        met.sort()
        # A token is here once for each time beyond the second.
        tokens, times = np.unique(met[2:][met[2:] == met[:-2]], return_counts=True)
        count = len(tokens)
        empty = pa.nulls(count, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([
            pa.nulls(count, arrow_id), pa.nulls(count, pa.int64()), pa.nulls(count, pa.int64()),
            pa.nulls(count, pa.binary()), empty, empty,
            pa.array(tokens.view(np.int64)), pa.array(times + 2),
        ], names=NAMES)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[np.ndarray] = []
        for batch in batches:
            arrow_id = batch.schema.field(0).type
            for some in _some(batch, 2):
                tokens, sizes = shingle_sets(some.column(2), size)
                yield rows(some.column(0), some.column(1), tokens, sizes)
                met.append(tokens)
                if sum(map(len, met)) > COUNTED:
                    yield often(met, arrow_id)
                    met = []
        if met:
            yield often(met, arrow_id)
        del met
        _let_go()

    return docs.select("id", "h", "t").mapInArrow(sketched, schema)


NAMES = ["id", "h", "n", "s", "mins", "bits", "token", "times"]


def _frequent(sketches: DataFrame) -> np.ndarray:
    """The most frequent tokens: at most FREQUENT, since their counts add up to the total."""
    times = sketches.filter(F.col("token").isNotNull()).groupBy("token").agg(
        F.sum("times").alias("times"))
    total = times.agg(F.sum("times")).first()[0] or 0
    found = times.filter(F.col("times") > max(8, total // FREQUENT)).select("token").toPandas()
    return np.sort(found["token"].to_numpy(np.int64).view(np.uint64))


def _compared(pairs: DataFrame, texts: DataFrame, size: int,
              percent: int) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (a, b) as stored, and those whose sets link, computed anew from the whole texts."""
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("r")).unionByName(
        pairs.select(F.col("b").alias("r"))).distinct()
    # While the ends are few, texts are picked where they lie and only those are shuffled.
    met = texts.join(lookup_side(ends), "r", "left_semi").select("r", "t")
    with_a = pairs.join(met.toDF("a", "ta"), "a")
    with_b = with_a.join(met.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for batch in batches:
            for some in _some(batch, 2):
                ends = [some.column(k).to_pylist() for k in (0, 1)]
                if sum(map(len, sets.values())) > KEPT_TOKENS:
                    sets = {}
                for end, column in zip(ends, (2, 3)):
                    new = {r: k for k, r in enumerate(end) if r not in sets}
                    tokens, sizes = shingle_sets(some.column(column).take(
                        pa.array(list(new.values()), pa.int64())), size)
                    sets.update(zip(new, np.split(tokens, np.cumsum(sizes)[:-1])))
                keep = []
                for p, q in zip(*(map(sets.__getitem__, end) for end in ends)):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1)], names=["a", "b"]).filter(
                    pa.array(keep, pa.bool_()))
        _let_go()

    return pairs, with_b.mapInArrow(linked, "a bigint, b bigint")


def _near_size(n, m, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _near_bits(n, m, bits, others, percent: int):
    """False if the parities tell that two sets of these sizes cannot link.

    A bit on which they differ stands for at least one token that only one of the sets has.
    """
    differ = F.aggregate(F.zip_with(bits, others, lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                         F.lit(0), lambda x, y: x + y)
    return differ <= n + m - 2 * _needed(n, m, percent)


def _groups(reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(r, g): similar sets in groups, by exact comparison with leaders.

    Each min-hash value has one leader. In every second permutation it is the most
    central of the sets that hold it, whose min-hashes are shared by the most
    sets: copies made from one text, that differ among each other more than from
    it, so meet that text. In the others it is any, by hash. A set meets a leader of another group if half of their min-hashes agree. A
    round is linear in the number of sets, however many share a value, and later
    ones only concern values that still occur in several groups.
    """
    known = reps.select("r", "n", "mins", "bits")
    groups = reps.select("r", F.col("r").alias("g"))
    values = reps.select("r", F.posexplode("mins").alias("k", "v"))
    shared = values.groupBy("k", "v").agg(F.count("*").alias("times")).filter("times > 1")
    # Sets that share no value meet nobody.
    central = values.join(shared, ["k", "v"]).groupBy("r").agg(F.sum("times").alias("central"))
    values = stored(values.join(central, "r"), "min-hashes")
    for turn in range(ROUNDS):
        keyed = values.withColumn("g", F.col("r")) if turn == 0 else values.join(groups, "r")
        leaders = keyed.groupBy("k", "v").agg(
            F.max_by(F.struct("r", "g"), F.struct(
                F.when(F.col("k") % 2 == 0, F.col("central")), F.xxhash64("r", "k", F.lit(turn))))
            .alias("leader"),
            (F.min("g") != F.max("g")).alias("several")).filter("several").drop("several")
        met = keyed.join(leaders, ["k", "v"]).filter("g <> leader.g").select(
            F.greatest("r", "leader.r").alias("a"), F.least("r", "leader.r").alias("b")).distinct()
        pairs = met.join(known.toDF("a", "na", "ma", "pa"), "a").join(
            known.toDF("b", "nb", "mb", "pb"), "b")
        agree = F.aggregate(F.zip_with("ma", "mb", lambda x, y: (x == y).cast("int")),
                            F.lit(0), lambda x, y: x + y)
        pairs = pairs.filter(
            (agree >= PERMUTATIONS // 2) & _near_size(F.col("na"), F.col("nb"), percent)
            & _near_bits(F.col("na"), F.col("nb"), "pa", "pb", percent)).select("a", "b")
        groups = _joined(groups, _compared(pairs, texts, size, percent))
    forget(values)
    return groups


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` after links (a, b) between their members."""
    pairs, links = links
    links = stored(links, "links")
    forget(pairs)
    ends = links.join(groups.toDF("a", "ga"), "a").join(groups.toDF("b", "gb"), "b").select(
        F.col("ga").alias("a"), F.col("gb").alias("b"))
    later = stored(groups.join(components(ends).withColumnRenamed("node", "g"), "g", "left").select(
        "r", F.coalesce("component", "g").alias("g")), "groups")
    forget(links)
    return later


def _prefixes(texts: DataFrame, frequent: np.ndarray, size: int, percent: int) -> DataFrame:
    """(token, r, off, place): each set's prefix in the common order.

    ``off`` is how far the group's number lies below ``r``, and ``place`` packs
    the set's size, the token's reach (see ``_least_hits``) and whether it is a
    frequent one, since these rows are the bulk of what is shuffled.
    """
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = sent.value
        maybe = np.zeros(1 << FIRST_BITS, bool)
        maybe[late >> np.uint64(64 - FIRST_BITS)] = True
        for batch in batches:
            for some in _some(batch, 2):
                tokens, sizes = shingle_sets(some.column(2), size)
                row = np.repeat(np.arange(len(sizes)), sizes)
                starts = np.cumsum(sizes) - sizes
                last = maybe[tokens >> np.uint64(64 - FIRST_BITS)]
                asked = np.flatnonzero(last)
                if len(asked):
                    where = np.minimum(np.searchsorted(late, tokens[asked]), len(late) - 1)
                    last[asked] = late[where] == tokens[asked]
                # Places in the common order: frequent tokens come after all others.
                before = np.cumsum(np.r_[0, last])
                early = sizes - (before[starts + sizes] - before[starts])
                behind = before[:-1] - before[starts][row]
                p = np.where(last, early[row] + behind, np.arange(len(row)) - starts[row] - behind)
                kept = np.flatnonzero(p < (sizes - least_overlap(sizes, percent) + 1)[row])
                p, own = p[kept], row[kept]
                reach = sizes[own] - p + sizes[own] // MORE
                place = (sizes[own] << 32) | (reach << 1) | (p >= early[own])
                taken = pa.array(own)
                yield pa.RecordBatch.from_arrays([
                    pa.array(tokens[kept].view(np.int64)), some.column(0).take(taken),
                    some.column(1).take(taken), pa.array(place),
                ], names=["token", "r", "off", "place"])
        _let_go()

    return texts.select("r", "off", "t").mapInArrow(
        prefix, "token bigint, r bigint, off bigint, place bigint")


def _in_two_groups(rows: DataFrame) -> DataFrame:
    """(token, r, g, n, reach): rows whose token is in two groups; the rest can link to nothing new.

    Frequent tokens are spread over all partitions and looked at afterwards, by
    an aggregate; the runs held here are of other tokens, which are few each.
    """
    count = partitions(rows.sparkSession)
    late = F.col("place").bitwiseAND(1) == 1
    salt = F.when(late, F.pmod(F.xxhash64("r"), F.lit(count))).otherwise(0)
    laid = rows.repartition(count, "token", salt).sortWithinPartitions("token")

    def shared(table: pa.Table) -> list[pa.RecordBatch]:
        if not table.num_rows:
            return []
        token = table.column("token").to_numpy()
        group = table.column("r").to_numpy() - table.column("off").to_numpy()
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        differs = np.minimum.reduceat(group, starts) != np.maximum.reduceat(group, starts)
        keep = np.repeat(differs, np.diff(np.r_[starts, len(token)]))
        return table.filter(pa.array(keep)).to_batches()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of the last token so far
        for batch in batches:
            frequent = pa.array(batch.column(3).to_numpy() & 1 == 1)
            yield batch.filter(frequent)
            rest = pa.Table.from_batches([batch]).filter(pc.invert(frequent))
            if not rest.num_rows:
                continue
            token = rest.column("token").to_numpy()
            cut = int(np.flatnonzero(token == token[-1])[0])
            if cut or held and held[0].column("token")[0].as_py() != token[0]:
                yield from shared(pa.concat_tables([*held, rest.slice(0, cut)]))
                held = []
            held.append(rest.slice(cut))
        if held:
            yield from shared(pa.concat_tables(held))

    late_row = F.col("place").bitwiseAND(1) == 1
    found = stored(laid.mapInArrow(runs, rows.schema), "found-tokens")
    kept = found.select(
        "token", "r", (F.col("r") - F.col("off")).alias("g"), late_row.alias("late"),
        F.shiftright("place", 32).cast("int").alias("n"),
        F.shiftright(F.col("place").bitwiseAND(0xFFFFFFFF), 1).cast("int").alias("reach"))
    # At most FREQUENT rows, so that the bulk is filtered where it lies.
    single = kept.filter("late").groupBy("token").agg(
        (F.min("g") == F.max("g")).alias("single")).filter("single").select("token")
    shared_tokens = stored(kept.join(F.broadcast(single), "token", "left_anti").drop("late"),
                           "shared-tokens")
    forget(found)
    return shared_tokens


def _across(rows: DataFrame, texts: DataFrame, groups: DataFrame, bits: DataFrame, size: int,
            percent: int) -> DataFrame:
    """``groups`` after all links between sets of different groups, by the token-group matrix.

    Which groups a set has to look into is found once. A set on the edge of a large
    group links to some of its members, and one link settles them all, so a few
    members are asked first, chosen by hash; the last turn asks all members of the
    groups that are then still apart.
    """
    rows = _in_two_groups(rows)
    opened = _opened(rows, percent)
    for share in SHARES:
        now = groups.toDF("r", "now")
        apart = opened.join(now, "r").join(now.toDF("g", "there"), "g").filter(
            "now <> there").select("r", "g", "n", "hits", "least")
        links = _compared(_candidates(apart, rows, share, percent, bits), texts, size, percent)
        groups = _joined(groups, links)
    forget(opened, rows)
    return groups


def _needed(n, m, percent: int):
    """Tokens that sets of these sizes share if they link."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def _more(n):
    """How many tokens beyond the one that must be shared are looked for."""
    return F.floor(n / F.lit(MORE))


def _least_hits(n, low, high, percent: int):
    """Tokens that the prefixes of a set and of one it links to share, whose size is in a range.

    Of two prefixes one ends first in the common order. All of its tokens that
    both sets have are in the other prefix too, and it has at most as many others
    as its set has beyond the overlap. So a prefix of one more than that holds a
    token both have, and one longer by ``_more`` holds as many more. A token's
    reach is how large an overlap may be needed for it to be in that prefix:
    what it leaves behind it, and ``_more``. Stored prefixes end after what the
    smallest overlap asks for. The overlap needed grows by less than the size, so
    for these the smallest and the largest partner decide.
    """
    def beyond(own, partner):
        prefix = own - F.ceil(F.lit(percent) * own / F.lit(100)) + 1
        return prefix - own + _needed(own, partner, percent)

    smallest = F.greatest(low, F.ceil(F.lit(percent) * n / F.lit(100)))
    largest = F.least(high, F.floor(F.lit(100) * n / F.lit(percent)))
    # In the largest partner rounding can hide a step of one.
    return F.greatest(F.lit(1), F.least(beyond(n, smallest), beyond(largest, n) - 1,
                                        1 + _more(n), 1 + _more(smallest)))


def _opened(rows: DataFrame, percent: int) -> DataFrame:
    """(r, g, n, hits, least): groups of which a member may link to the set.

    ``hits`` are the tokens both hold, those that fewest members hold first, and
    ``least`` of them any such member has. Each pair of groups is looked at from one side.
    """
    # The matrix: the union of a group's prefixes, with the sizes of the sets that hold a token.
    matrix = rows.groupBy("token", "g").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("furthest"),
        F.count("*").alias("held"))
    query = rows.select("token", "r", "n", "reach", F.col("g").alias("own"))
    smallest = F.greatest(F.col("low"), F.ceil(F.lit(percent) * F.col("n") / F.lit(100)))
    counted = query.join(matrix, "token").filter(
        (F.col("g") < F.col("own"))
        & (F.least("reach", "furthest") >= _needed(F.col("n"), smallest, percent)) & (100 * F.col("high") >= percent * F.col("n"))
        & (100 * F.col("n") >= percent * F.col("low"))
    ).groupBy("r", "g").agg(
        F.collect_list(F.struct("held", "token")).alias("hits"), F.min("n").alias("n"),
        F.min("low").alias("low"), F.max("high").alias("high"))
    least = _least_hits(F.col("n"), F.col("low"), F.col("high"), percent)
    return stored(counted.withColumn("least", least.cast("int")).filter(
        F.size("hits") >= F.col("least")).select(
        "r", "g", "n", F.sort_array("hits")["token"].alias("hits"), "least"), "opened")


def _candidates(opened: DataFrame, rows: DataFrame, share: int, percent: int,
                bits: DataFrame | None = None) -> DataFrame:
    """(a, b): sets and members of opened groups that may link, one in ``share`` of the members.

    A member that holds ``least`` of the hits holds one of any but ``least - 1`` of
    them, so it is met by its rarest ones; tokens that all of a large group share
    join nothing. Whom a set has met is then compared with all of its hits at once,
    and by the parities in ``bits`` (r, bits).
    """
    members = rows.select("token", F.col("r").alias("m"), F.col("n").alias("mn"), "g",
                          F.col("reach").alias("furthest"))
    if share > 1:
        members = members.filter(F.pmod(F.xxhash64("m"), F.lit(share)) == 0)
    rarest = F.slice("hits", 1, F.size("hits") - F.col("least") + 1)
    asked = opened.select("r", "g", "n", F.explode(rarest).alias("token"))
    # Tokens count up to what this member's size asks for, which may be more than the group's.
    pairs = asked.join(members, ["token", "g"]).filter(
        _near_size(F.col("n"), F.col("mn"), percent)
        & (F.col("furthest") >= _needed(F.col("n"), F.col("mn"), percent))
    ).select("r", "g", "m").distinct()
    own = members.groupBy("m").agg(F.collect_list("token").alias("own"), F.min("mn").alias("mn"))
    asking = opened.select("r", "g", "n", "hits")
    near = F.lit(True)
    if bits is not None:
        asking = asking.join(bits, "r")
        own = own.join(bits.toDF("m", "others"), "m")
        near = _near_bits(F.col("n"), F.col("mn"), "bits", "others", percent)
    met = pairs.join(asking, ["r", "g"]).join(own, "m").filter(near).withColumn(
        "hits", F.size(F.array_intersect("hits", "own")))
    least = _least_hits(F.col("n"), F.col("mn"), F.col("mn"), percent)
    return met.filter(F.col("hits") >= least).select(
        F.greatest("r", "m").alias("a"), F.least("r", "m").alias("b"))


def link_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with ``n_shingles`` and ``component_id``.

    Two texts link when their shingle sets share at least ``percent`` of their
    union; a component is what links reach, named by its smallest id. A text
    without words has no shingles and links with nothing. Rows of one id and
    different texts are different texts; repeated rows each get the answer.
    A null id is never a component's name unless no other is there. An empty
    table gives an empty result; other columns are ignored.
    """
    return _linked(docs, size, percent, id_column, text_column)[0].select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")


def _linked(docs: DataFrame, size: int, percent: int, id_column: str,
            text_column: str) -> tuple[DataFrame, list[DataFrame]]:
    """(id, h, n, component_id) of every row, ``h`` being the hash of its text.

    Comes with the stored tables it is read from.
    """
    text = text_of(text_column)
    docs = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    sketches = stored(_sketches(docs, size), "sketches")
    sets = sketches.filter(F.col("n").isNotNull())
    reps = sets.filter("n > 0").groupBy("s").agg(
        F.min(F.struct("id", "h")).alias("one"), F.min("id").alias("least_id"),
        F.first("n").alias("n"), F.first("mins").alias("mins"), F.first("bits").alias("bits"))
    # Copies, by far fewer than texts as a rule, are taken out where the texts lie.
    copies = stored(sets.filter("n > 0").join(reps.select("s", "one"), "s").filter(
        ~F.col("id").eqNullSafe(F.col("one.id")) | (F.col("h") != F.col("one.h"))
    ).select(F.col("id").alias("cid"), F.col("h").alias("ch")).distinct(), "copies")
    all_texts = stored(docs.filter(F.col("t").rlike("[^\\x20\\x09-\\x0D]")).join(
        lookup_side(copies), F.col("id").eqNullSafe(F.col("cid")) & (F.col("h") == F.col("ch")),
        "left_anti").withColumn("r", F.monotonically_increasing_id()), "set-texts")
    # Rows repeated in full are still there as often; the first of each stands for the set.
    keyed = all_texts.select("r", F.col("id").alias("rid"), F.col("h").alias("rh"))
    first = keyed.groupBy("rid", "rh").agg(F.min("r").alias("r"), F.count("*").alias("rows"))
    reps = stored(reps.join(first, F.col("one.id").eqNullSafe(F.col("rid"))
                            & (F.col("one.h") == F.col("rh"))).drop("rows", "rid", "rh"), "sets")
    again = first.filter("rows > 1").toDF("fid", "fh", "fr", "rows")
    spare = stored(keyed.join(again, F.col("rid").eqNullSafe(F.col("fid")) & (
        F.col("rh") == F.col("fh"))).filter("r <> fr").select("r"), "spare-rows")
    texts = all_texts.join(lookup_side(spare), "r", "left_anti").select("r", "t")
    groups = _groups(reps, texts, size, percent)
    joined = groups.filter("g <> r").select("r", (F.col("r") - F.col("g")).alias("off"))
    numbered = texts.join(lookup_side(joined), "r", "left").select(
        "r", F.coalesce("off", F.lit(0)).alias("off"), "t")
    rows = _prefixes(numbered, _frequent(sketches), size, percent)
    groups = _across(rows, texts, groups, reps.select("r", "bits"), size, percent)
    forget(copies, all_texts, spare)
    named = reps.select("s", "r", "least_id").join(groups.withColumnRenamed("g", "c"), "r")
    names = named.groupBy("c").agg(F.min("least_id").alias("component_id"))
    found = named.join(names, "c").select("s", "component_id")
    # A third of the texts may share one set: its rows can be split, the other side has one.
    counted = sets.filter("n > 0").join(found, "s").select("id", "h", "n", "component_id")
    alone = sets.filter("n = 0").select("id", "h", "n", F.col("id").alias("component_id"))
    return counted.unionByName(alone), [sketches, reps, groups]


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """The rows whose id names their component: one of each group, all that are alone.

    Null, empty and repeated texts as in ``link_documents``: all texts without
    words stay, and so do all rows that repeat the id and text that stays.
    """
    gone_id, gone_hash = free_names(docs, "_gone", "_hash")
    linked, tables = _linked(docs, SHINGLE, PERCENT, id_column, text_column)
    gone = stored(linked.filter(
        ~F.col("id").eqNullSafe(F.col("component_id"))).select(
        F.col("id").alias(gone_id), F.col("h").alias(gone_hash)).distinct(), "near-copies")
    forget(*tables)
    return docs.join(lookup_side(gone), F.col(id_column).eqNullSafe(F.col(gone_id)) & (
        F.xxhash64(text_of(text_column)) == F.col(gone_hash)), "left_anti")
