"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Every text gets a 64-bit SimHash of its word shingles. Fingerprints that differ
in at most ``distance`` bits are linked, and linked fingerprints form groups.

Finding the links: the 64 bits are dealt into ``parts`` partitions that keep
correlated bits together, so that the partitions vary independently of one
another. If the partitions' thresholds sum to distance - parts + 1, two
fingerprints within ``distance`` agree within its threshold in at least one
partition. The thresholds are unequal: dynamic programming picks those with the
least estimated number of probes and candidates, from the bit statistics of all
fingerprints. Each fingerprint is put into the buckets of a small Hamming ball
around its bits in a partition; the members of a bucket are verified by their
full distance.

Only the links of a spanning forest of each bucket are emitted, so large groups
of near copies cost rows in proportion to their size. Equal fingerprints are
collapsed first. A bucket with more than ``BUCKET`` distinct fingerprints is
streamed on to an exact path without buckets: fingerprints that share a point of
their radius-(distance/2) balls are linked by the triangle inequality.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import LOWER, UPPER, checkpoint, for_workers
from panelforge.llm.components import connected_components, skew_join

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Two partitions of 32 bits: keys long enough that chance collisions stay rare up to billions of fingerprints.
PARTS = 2
#: Distinct fingerprints that one bucket may hold in a worker's memory at once.
BUCKET = 65_536


# --- fingerprints -------------------------------------------------------------------------------------------


def split_words(text: str | None) -> list[bytes]:
    """The words of a whole text, A to Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).split()


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of at least one word; of fewer words than a shingle has, the one of all of them."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes) - 1
    n = max(1, len(words) - shingle + 1)
    starts, stops = (ends - sizes + 1)[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype="<u8")


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``."""
    ones, n = np.zeros(BITS, dtype=np.int64), len(hashes)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a whole text as an unsigned integer; 0 without words."""
    words = split_words(text)
    return majority_bits(shingle_hashes(words, shingle, seed)) if words else 0


_LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return for_workers(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- partitions and thresholds ------------------------------------------------------------------------------


def bit_statistics(values: DataFrame) -> tuple[int, np.ndarray]:
    """How many distinct fingerprints there are, and in how many each pair of bits is set; all of them count."""

    def run(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            if batch.num_rows:
                bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both, n = both + bits.T @ bits, n + len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([*both.ravel(), n], pa.float64()), pa.array(range(BITS * BITS + 1), pa.int32())], ["n", "cell"])

    rows = values.select("fp").mapInArrow(run, "n double, cell int").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of equal width that keep correlated bits together, grown greedily from the strongest pair left."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        pair = np.unravel_index(np.argmax(corr[np.ix_(left, left)]), (len(left), len(left)))
        group = list(dict.fromkeys(left[i] for i in pair))[:width]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(axis=1)))])
        left = [b for b in left if b not in group]
        out.append(sorted(group))
    return out


def ball_rows(width: int, threshold: int) -> int:
    """Buckets that a fingerprint enters for a partition's threshold."""
    if threshold < 0:
        return 0
    radius = -(-threshold // 2)
    return sum(len(list(combinations(range(width), k))) for k in range(radius + 1))


def allocate(n: int, both: np.ndarray, groups: list[list[int]], distance: int) -> list[int]:
    """Thresholds (-1: the partition isn't probed) that sum to distance - parts + 1, by dynamic programming on estimated rows and candidates."""
    return _cheapest(n, both, groups, distance)[1]


def _cheapest(n: int, both: np.ndarray, groups: list[list[int]], distance: int, row_cost: float = 1.0) -> tuple[float, list[int]]:
    """The least cost of thresholds, and these; a probe's row costs as much as ``row_cost`` comparisons."""
    p = np.diag(both) / max(n, 1)
    costs = []
    for group in groups:
        mismatch = 2 * p[group] * (1 - p[group])
        dist = np.array([1.0])
        for q in mismatch:
            dist = np.convolve(dist, [1 - q, q])
        row = {-1: 0.0}
        for e in range(min(distance, len(group)) + 1):
            row[e] = row_cost * n * ball_rows(len(group), e) + 0.5 * n * n * float(dist[: e + 1].sum())
        costs.append(row)
    best = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, picks) in best.items():
            for e, c in row.items():
                if total + e not in step or cost + c < step[total + e][0]:
                    step[total + e] = (cost + c, [*picks, e])
        best = step
    return best[distance - len(groups) + 1]


# --- probe and verify ---------------------------------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _entries(part: int, group: list[int], threshold: int) -> Column:
    """The buckets (part, value) that column fp enters in one partition."""
    own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in group))))
    flips = [sum(1 << b for b in c) for r in range(-(-threshold // 2) + 1) for c in combinations(group, r)]
    masks = F.array(*[F.lit(_signed(m)) for m in flips])
    if threshold == 1:
        # of two values one bit apart, the one that has the bit meets the other by clearing it
        masks = F.filter(masks, lambda m: own.bitwiseAND(m) == m)
    return F.transform(masks, lambda m: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(m).alias("value")))


def probes(values: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """part, value and the columns of ``values``: each fingerprint in the buckets of its balls."""
    found = [_entries(k, group, e) for k, (group, e) in enumerate(zip(groups, thresholds, strict=True)) if e >= 0]
    return values.select("*", F.explode(F.concat(*found)).alias("x")).select("x.part", "x.value", *values.columns)


def spanning_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct ``fps``, breadth first."""
    a, b = [], []
    rest, front = fps[1:], [fps[0]] if len(fps) else []
    while len(rest):
        if not front:
            front, rest = [rest[0]], rest[1:]
            continue
        x = front.pop()
        near = np.bitwise_count(rest ^ x) <= distance
        if near.any():
            got = rest[near]
            a.append(np.full(len(got), x, dtype=fps.dtype))
            b.append(got)
            front.extend(got)
            rest = rest[~near]
    empty = np.zeros(0, dtype=fps.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _verify(batches, distance: int, bucket: int):
    """src, dst of links; dst is null for a member of a bucket that is too large to hold."""
    held = [np.zeros(0, np.int64)] * 3
    spilling = None  # the bucket whose members are being passed on

    def emit(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64), pa.int64()), b if isinstance(b, pa.Array) else pa.array(b.view(np.int64), pa.int64())], ["src", "dst"])

    def buckets(part, value, fp):
        """Links within the complete buckets of sorted rows."""
        new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (value[1:] != value[:-1])])
        size = np.diff(np.r_[new, len(fp)])
        keep = np.repeat(size, size) > 1
        u = fp.view(np.uint64)
        pair = new[size == 2]
        x, y = u[pair], u[pair + 1]
        near = np.bitwise_count(x ^ y) <= distance
        near &= x != y
        out = [(x[near], y[near])]
        if keep.any():
            for at, n in zip(new[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                out.append(spanning_links(np.unique(u[at : at + n]), distance))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    for batch in batches:
        part, value, fp = (np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True))
        if not len(fp):
            continue
        if spilling is not None:
            same = (part == spilling[0]) & (value == spilling[1])
            n = int(same.sum())  # rows are sorted, so these come first
            if n:
                yield emit(fp[:n], pa.nulls(n, pa.int64()))
            part, value, fp = part[n:], value[n:], fp[n:]
            if not len(fp):
                held = [part, value, fp]
                continue
            spilling = None
        last = int(np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (value[1:] != value[:-1])])[-1])
        if last:
            yield emit(*buckets(part[:last], value[:last], fp[:last]))
        if len(fp) - last > bucket:
            spilling = (part[last], value[last])
            yield emit(fp[last:], pa.nulls(len(fp) - last, pa.int64()))
            held = [part[:0], value[:0], fp[:0]]
        else:
            held = [part[last:], value[last:], fp[last:]]
    if len(held[2]):
        yield emit(*buckets(*held))


def ball_links(values: DataFrame, distance: int) -> DataFrame:
    """Exact links of ``values`` without buckets, in rows proportional to their number.

    Two fingerprints are within d exactly if a ball of radius ceil(d/2) about
    one and of radius floor(d/2) about the other share a point. Of the narrow
    balls that share a point only the least is linked with the others: the rest
    meet it there too.
    """
    wide, slim = -(-distance // 2), distance // 2
    points = lambda r: F.array(*[F.lit(_signed(sum(1 << b for b in c))) for k in range(r + 1) for c in combinations(range(BITS), k)])
    centre = values.select("fp", F.explode(points(slim)).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    least = centre.groupBy("point").agg(F.min("fp").alias("dst"))
    outer = centre if wide == slim else values.select("fp", F.explode(points(wide)).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    return skew_join(outer, least, "point").where("fp <> dst").select(F.col("fp").alias("src"), "dst").distinct()


def links(values: DataFrame, distance: int = DISTANCE, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """src, dst: links that connect every two of the distinct ``values`` (fp) within ``distance`` bits."""
    n, both = bit_statistics(for_workers(values))
    groups = group_bits(n, both, parts)
    thresholds = allocate(n, both, groups, distance)
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out before they multiply: adaptive execution would put the few rows into a task or two
    dealt = probes(values.repartition(tasks), groups, thresholds)
    dealt = dealt.repartition(tasks, "part", "value").sortWithinPartitions("part", "value")
    found = checkpoint(dealt.mapInArrow(lambda batches: _verify(batches, distance, bucket), "src long, dst long").distinct())
    out = found.where("dst is not null")
    crowd = found.where("dst is null").select(F.col("src").alias("fp"))
    if crowd.take(1):
        out = out.unionByName(ball_links(crowd, distance))
    return out


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, parts: int = PARTS, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable) of every row.

    Null and empty texts have fingerprint zero and are linked like any others.
    Rows with a null id keep it; their group's id is its least id that isn't
    null. Repeated rows are kept. An empty table gives an empty one.
    """
    stored = checkpoint(fingerprints(docs, shingle, id_col=id_col, text_col=text_col))
    values = stored.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = connected_components(links(values.select("fp"), distance, parts, bucket))
    joined = skew_join(values, groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = skew_join(joined, least, "component").select("fp", "component_id")
    out = skew_join(stored, named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies confirmed on shingles ----------------------------------------------------------------------

#: Words of a shingle, and the Jaccard similarity of the sets of them, that make a near duplicate.
CONFIRM_WORDS = 5
SIMILARITY = 0.8
#: Bits in the search for them, by SimHashes of the distinct words and the word pairs, of which a replaced word spoils
#: few where it spoils five longer shingles. Over 0.8 they differ by 4 or 5 bits at the median, and by over 10 in 3 of 1000.
CANDIDATE_DISTANCE = 10
#: Candidates differ by no more bits in the SimHash of the confirming shingles. At 0.8 its mean is 10, its deviation 3.
FINE_DISTANCE = 24
#: What the row of a probe costs, in comparisons.
ROW_COST = 200.0
#: Links a member that a crowded bucket emits, the nearest ones; the rest is left to ``crowd_links``.
NEAREST = 2
#: Members of a block of a crowd.
BLOCK = 512


def shingle_set(text: str | None, words: int = CONFIRM_WORDS) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    found = split_words(text)
    return np.unique(shingle_hashes(found, words)) if found else np.zeros(0, "<u8")


def wide_fingerprint(words: list[bytes]) -> int:
    """The SimHash of a text's distinct words and of its word pairs; 0 without words."""
    return majority_bits(np.concatenate([np.unique(shingle_hashes(words, 1)), shingle_hashes(words, 2)])) if words else 0


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, fp (for the search), fine (of the confirming shingles) and key (128 bits of the set of these) of doc_id, text."""

    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = split_words(text.as_py())
                if not words:
                    rows.append((0, 0, xxh3_128_digest(b"")))
                    continue
                hashes = shingle_hashes(words, CONFIRM_WORDS)
                rows.append((wide_fingerprint(words), majority_bits(hashes), xxh3_128_digest(np.unique(hashes).tobytes())))
            fp, fine, key = zip(*rows, strict=True) if rows else ((), (), ())
            bits = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (fp, fine)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *bits, pa.array(key, pa.binary())], ["doc_id", "fp", "fine", "key"])

    return for_workers(docs).mapInArrow(run, "doc_id long, fp long, fine long, key binary")


def plan_search(n: int, both: np.ndarray, distance: int) -> tuple[list[list[int]], list[int]]:
    """The number of partitions, with their bits and thresholds, that is cheapest for ``n`` fingerprints."""
    options = []
    for parts in range(2, 6):
        groups = group_bits(n, both, parts)
        options.append((*_cheapest(n, both, groups, distance, ROW_COST), groups))
    _, thresholds, groups = min(options, key=lambda o: o[0])
    return groups, thresholds


def _near(fp: np.ndarray, fine: np.ndarray, a, b, distance: int, ours=None) -> np.ndarray:
    near = (np.bitwise_count(fp[a] ^ fp[b]) <= distance) & (np.bitwise_count(fine[a] ^ fine[b]) <= FINE_DISTANCE)
    return near if ours is None else near & ours(fp[a], fp[b])


def left_to_bucket(groups: list[list[int]], thresholds: list[int]):
    """A test of whether the pair x, y is judged in bucket (part, value), of those that it shares.

    Not if an earlier partition finds it too, nor if the two agree in the
    partition and the bucket isn't that of their own bits: there they meet as well.
    """
    masks = [np.uint64(sum(1 << b for b in g)) for g in groups]

    def ours(part: int, value, x, y):
        differ = x ^ y
        mine = ((differ & masks[part]) != 0) | ((x & masks[part]) == value)
        for mask, threshold in zip(masks[:part], thresholds[:part], strict=True):
            if threshold >= 0:
                mine = mine & (np.bitwise_count(differ & mask) > threshold)
        return mine

    return ours


def _forest(fp: np.ndarray, fine: np.ndarray, distance: int, ours=None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends of a spanning forest of the near pairs, breadth first."""
    a, b, rest, front = [], [], np.arange(1, len(fp)), [0]
    while len(rest):
        if not front:
            front, rest = [int(rest[0])], rest[1:]
            continue
        x = front.pop()
        near = _near(fp, fine, x, rest, distance, ours)
        got = rest[near]
        a.append(np.full(len(got), x))
        b.append(got)
        front.extend(got.tolist())
        rest = rest[~near]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def bucket_pairs(fp: np.ndarray, fine: np.ndarray, distance: int, nearest: int = NEAREST, leaders: int | None = None, ours=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of near pairs of a bucket, of a spanning forest (later, earlier) and of the members of pairs that were left out.

    All pairs and no forest, unless there are over ``nearest`` pairs a member:
    then each member's nearest ones. With ``leaders``, members are compared with
    the first so many only, all count as left out and are tied to the first. Pairs
    that ``ours`` denies are another bucket's.
    """
    m = len(fp)
    top = m if leaders is None else min(leaders, m)
    later, earlier, crowded, out = [], [], leaders is not None, [np.zeros(0, np.int64)]
    fine_of = lambda r, c: np.bitwise_count(fine[r] ^ fine[c])

    def trim(r, c):
        order = np.lexsort((fine_of(r, c), r))
        r, c = r[order], c[order]
        start = np.r_[0, np.flatnonzero(r[1:] != r[:-1]) + 1] if len(r) else np.zeros(0, np.int64)
        place = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
        far = place >= nearest
        out.append(np.unique(np.r_[r[far], c[far]]))
        return r[~far], c[~far]

    step, total = max(1, 2_000_000 // max(top, 1)), 0
    for at in range(0, m, step):
        rows = np.arange(at, min(at + step, m))
        r, c = np.nonzero(_near(fp, fine, rows[:, None], np.arange(min(top, rows[-1] + 1))[None, :], distance, ours))
        r = r + at
        r, c = r[c < r], c[c < r]
        total += len(r)
        if not crowded and total > nearest * m:
            crowded = True
            before = trim(np.concatenate([*later, r]), np.concatenate([*earlier, c]))
            later, earlier = [before[0]], [before[1]]
            continue
        if crowded:
            r, c = trim(r, c)
        later.append(r)
        earlier.append(c)
    empty = np.zeros(0, np.int64)
    tied, to = (empty, empty)
    if leaders is not None:
        out, tied, to = [np.arange(m)], np.arange(1, m), np.zeros(m - 1, np.int64)
    elif crowded:
        to, tied = _forest(fp, fine, distance, ours)
    return np.concatenate(later), np.concatenate(earlier), tied, to, np.unique(np.concatenate(out))


def _candidates(batches, distance: int, bucket: int, nearest: int, ours):
    """src, dst, tie of rows of part, value, id, fp, fine sorted by part and value.

    Candidate pairs; where dst is null, a member of left-out pairs; where tie is
    true, what holds such members of one bucket together.
    """
    names = ["part", "value", "id", "fp", "fine"]
    held = None
    first = None  # of a bucket that is too large to hold: its first members

    def emit(ids, later, earlier, tied, to, out):
        for src, dst, tie in ((ids[later], ids[earlier], False), (ids[tied], ids[to], True), (ids[out], pa.nulls(len(out), pa.int64()), False)):
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(np.full(len(src), tie))], ["src", "dst", "tie"])

    def whole(rows):
        """Pairs of complete buckets."""
        part, value, ids, fp, fine = rows
        fp, fine = fp.view(np.uint64), fine.view(np.uint64)
        new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (value[1:] != value[:-1])])
        size = np.diff(np.r_[new, len(fp)])
        two = new[size == 2]
        two = two[_near(fp, fine, two, two + 1, distance)]
        own = value.view(np.uint64)
        two = np.concatenate([two[:0], *(t[ours(k, own[t], fp[t], fp[t + 1])] for k in np.unique(part[two]).tolist() for t in [two[part[two] == k]])])
        empty = np.zeros(0, np.int64)
        found = [(two + 1, two, empty, empty, empty)]
        for at, n in zip(new[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            got = bucket_pairs(fp[at : at + n], fine[at : at + n], distance, nearest, ours=partial(ours, int(part[at]), own[at]))
            if len(got[0]):
                found.append(tuple(x + at for x in got))
        yield from emit(ids, *map(np.concatenate, zip(*found, strict=True)))

    def large(before, rows):
        """Pairs of members of a large bucket with ``before``, its first ones."""
        n, both = len(before[2]), [np.concatenate(x) for x in zip(before, rows, strict=True)]
        got = bucket_pairs(both[3].view(np.uint64), both[4].view(np.uint64), distance, nearest, leaders=n)
        start = n if len(rows[2]) else 0
        yield from emit(both[2], *(x[k >= start] for x, k in zip(got, (got[0], got[0], got[2], got[2], got[4]), strict=True)))

    for batch in batches:
        rows = [batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)]
            held = None
        if first is not None and len(rows[0]):
            same = int(((rows[0] == first[0][0]) & (rows[1] == first[1][0])).sum())  # rows are sorted, so these come first
            if same:
                yield from large(first, [x[:same] for x in rows])
            rows = [x[same:] for x in rows]
            if len(rows[0]):
                first = None
        if not len(rows[0]):
            continue
        part, value = rows[:2]
        last = int(np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (value[1:] != value[:-1])])[-1])
        if last:
            yield from whole([x[:last] for x in rows])
        held = [x[last:] for x in rows]
        if len(held[0]) > bucket:
            yield from large(held, [x[:0] for x in held])
            first, held = [x[:bucket] for x in held], None
    if held is not None:
        yield from whole(held)


def candidate_pairs(nodes: DataFrame, distance: int = CANDIDATE_DISTANCE, bucket: int = BUCKET, nearest: int = NEAREST) -> DataFrame:
    """src, dst, tie: pairs of ``nodes`` (id, fp, fine) within ``distance`` bits; with a null dst, the ids that take part in pairs left out; with tie, what holds a crowd together."""
    groups, thresholds = plan_search(*bit_statistics(for_workers(nodes)), distance)
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = probes(nodes.select("id", "fp", "fine").repartition(tasks), groups, thresholds)
    dealt = dealt.repartition(tasks, "part", "value").sortWithinPartitions("part", "value", "id")
    ours = left_to_bucket(groups, thresholds)
    return checkpoint(dealt.mapInArrow(lambda batches: _candidates(batches, distance, bucket, nearest, ours), "src long, dst long, tie boolean").where("dst is null or src <> dst").distinct())


def intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``: products of incidence matrices, ``width`` elements at a time."""
    vocabulary = np.intersect1d(*[np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in (left, right)])
    found = np.zeros((len(left), len(right)), np.float32)
    placed = []
    for sets in (left, right):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        at = np.searchsorted(vocabulary, flat)
        known = at < len(vocabulary)
        known[known] = vocabulary[at[known]] == flat[known]
        order = np.argsort(at[known], kind="stable")
        placed.append((at[known][order], row[known][order]))
    for low in range(0, len(vocabulary), width):
        parts = []
        for (at, row), sets in zip(placed, (left, right), strict=True):
            a, b = np.searchsorted(at, [low, low + width])
            x = np.zeros((len(sets), width), np.float32)
            x[row[a:b], at[a:b] - low] = 1
            parts.append(x)
        found += parts[0] @ parts[1].T
    return found


def _block_links(table: pa.Table, distance: int, similarity: float) -> pa.Table:
    """Links between members of different components, of the two blocks of a group or within its one: at most one fewer than there are components."""
    from pyarrow import compute

    left, right = (table.filter(compute.equal(table["side"], k)) for k in (0, 1))
    if not right.num_rows:
        right = left
    column = lambda t, c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
    sets = [[np.asarray(s, np.int64) for s in t["s"].combine_chunks().to_numpy(zero_copy_only=False)] for t in (left, right)]
    both = intersections(*sets)
    size = [np.array([len(s) for s in x], np.float32) for x in sets]
    union = size[0][:, None] + size[1][None, :] - both
    (fp, fine, comp, ids) = ([column(t, c) for t in (left, right)] for c in ("fp", "fine", "component", "id"))
    bits = lambda x: np.bitwise_count(x[0].view(np.uint64)[:, None] ^ x[1].view(np.uint64)[None, :])
    ok = (both >= similarity * union) & (comp[0][:, None] != comp[1][None, :]) & (bits(fp) <= distance) & (bits(fine) <= FINE_DISTANCE)
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    src, dst = [], []
    for i, j in zip(*np.nonzero(ok), strict=True):
        a, b = find(int(comp[0][i])), find(int(comp[1][j]))
        if a != b:
            root[a] = b
            src.append(int(ids[0][i]))
            dst.append(int(ids[1][j]))
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def crowd_links(members: DataFrame, distance: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """src, dst that join the components of each crowd wherever two members of different ones are alike.

    ``members``: crowd, component, id, fp, fine, s. Blocks of members are held
    against one another, save blocks of one and the same component. So the work
    is the product of a crowd's size and its members outside its large
    components; a task holds two blocks.
    """
    sizes = members.groupBy("crowd", "component").agg(F.count(F.lit(1)).alias("_n"))
    # small components share blocks
    dealt = sizes.withColumn("_own", F.when(F.col("_n") >= block, F.col("component")))
    blocks = dealt.groupBy("crowd", "_own").agg(F.ceil(F.sum("_n") / block).alias("_blocks"))
    dealt = dealt.join(blocks.withColumnsRenamed({"crowd": "_c", "_own": "_o"}), F.expr("crowd = _c and _own <=> _o")).select("crowd", "component", "_own", "_blocks")
    placed = members.join(dealt, ["crowd", "component"]).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    listed = blocks.select("crowd", "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    name = F.concat_ws(":", F.coalesce(F.col("_own").cast("string"), F.lit("")), F.col("_block").cast("string"))
    listed = listed.select("crowd", "_own", name.alias("a"))
    pairs = listed.join(listed.withColumnsRenamed({"_own": "_o", "a": "b"}), "crowd").where("a < b and not coalesce(_own = _o, false) or a = b and _own is null")
    sides = pairs.select("crowd", "a", "b", F.explode(F.array(F.struct(F.col("a").alias("name"), F.lit(0).alias("side")), F.struct(F.col("b").alias("name"), F.lit(1).alias("side")))).alias("x"))
    sides = sides.select("crowd", "a", "b", "x.name", "x.side").where("side = 0 or a <> b")
    rows = placed.withColumn("name", name).join(sides, ["crowd", "name"]).select("crowd", "a", "b", "side", "id", "component", "fp", "fine", "s")
    return for_workers(rows).groupBy("crowd", "a", "b").applyInArrow(lambda t: _block_links(t, distance, similarity), "src long, dst long")


def confirmed_duplicates(docs: DataFrame, similarity: float = SIMILARITY, distance: int = CANDIDATE_DISTANCE, bucket: int = BUCKET, nearest: int = NEAREST, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id of all rows of each group of near duplicates but the least.

    Two texts are linked if their sets of 5-word shingles are equal, or if
    SimHashes of their words and word pairs differ in at most ``distance`` bits
    and the sets have a Jaccard similarity of at least ``similarity``. Groups are the
    components of these links and of no others. Equal sets are collapsed first.
    Rows that share an id are one document, of the greater set. Texts without
    words are equal. Rows without an id, and groups of one, aren't returned; an
    empty table gives an empty one.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    stored = checkpoint(sketches(known))
    nodes = stored.groupBy("key").agg(F.min("doc_id").alias("id"), F.min(F.struct("fp", "fine")).alias("x")).select("key", "id", "x.fp", "x.fine")
    found = candidate_pairs(nodes, distance, bucket, nearest)
    pairs = found.where("dst is not null and not tie").select("src", "dst")

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    wanted = found.select(F.explode(F.array("src", "dst")).alias("doc_id")).where("doc_id is not null").distinct()
    sets = checkpoint(for_workers(known.join(wanted, "doc_id", "left_semi")).mapInArrow(run, "id long, s array<long>").groupBy("id").agg(F.max("s").alias("s")))
    named = lambda end: sets.select(F.col("id").alias(end), F.col("s").alias(f"_{end}"))
    both = F.size(F.array_intersect("_src", "_dst"))
    alike = both >= similarity * (F.size("_src") + F.size("_dst") - both)
    confirmed = skew_join(skew_join(pairs, named("src"), "src"), named("dst"), "dst").where(alike).select("src", "dst")
    rows = skew_join(stored.select("doc_id", "key"), nodes.select("key", "id"), "key").select("doc_id", "id")
    shared = rows.groupBy("doc_id").agg(F.min("id").alias("dst"), F.max("id").alias("_most")).where("dst <> _most").select("doc_id", "dst")
    confirmed = checkpoint(confirmed.unionByName(rows.join(shared, "doc_id").where("id <> dst").select(F.col("id").alias("src"), "dst")))
    groups = connected_components(confirmed)
    crowd = found.where("dst is null").select(F.col("src").alias("id"))
    if crowd.take(1):
        near = connected_components(found.where("tie")).select(F.col("node").alias("id"), F.col("component").alias("crowd"))
        members = skew_join(skew_join(crowd, near, "id"), sets, "id")
        members = skew_join(members, groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        members = checkpoint(skew_join(members, nodes.select("id", "fp", "fine"), "id"))
        groups = connected_components(confirmed.unionByName(crowd_links(members, distance, similarity, block)))
    least = skew_join(rows, groups.withColumnRenamed("node", "id"), "id", "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    return least.where("doc_id <> component").select("doc_id").distinct()
