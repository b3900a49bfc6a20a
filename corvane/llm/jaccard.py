"""Exact Jaccard join of documents on word n-grams by partitioning the universe of tokens.

A set is the distinct hashed n-grams of a text; documents with equal sets are one class. Sizes fall into bands that
double. Each band has a scheme: a number of partitions into which a hash deals all tokens. A class signs in its own
band's scheme, and in the scheme below if a partner may have that size. Two sets with a similarity of at least t differ
in at most H = (1 - t) / (1 + t) * (x + y) tokens. In an exact scheme a class signs every non-empty segment (the tokens
of one partition): of more than H signed segments at least one is equal in the partner. Small sets may not have that
many segments; their schemes also sign the segments less one token (one-deletion neighbourhood), and a segment of two
or more tokens then counts twice. ``allocation`` takes the cheaper way that reaches the weight.

A signature that more than ``HOT`` classes share makes no pairs. A class that still has the weight without its hot
signatures finds all its partners by the others, and a pair is found if either side does. Pairs must also share as many
signatures as the difference allows, which leaves few false ones. Classes without that weight ("heavy": large groups of
near copies, texts of common passages) are linked to their hot signatures instead. Links of both kinds only make coarse
groups; every group is verified exactly, cut into tiles of bounded size that count common tokens by postings and return
a spanning forest of the true links. A last pass over these gives the components.

Only signatures (16 bytes, about two thirds of one a token) are shuffled by the whole corpus; sets are built again for
the classes of coarse groups alone. Similarities are exact up to collisions of 64-bit hashes.

Cases: a null or empty text and one of blanks has an empty set and is linked with nothing; fewer words than an n-gram
are one token; equal sets are linked; rows that repeat an id are rows of their own; a null id never names a component
unless it has no other id; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import stored, work_folder
from corvane.llm.components import components

WORDS = 5
PERCENT = 75
HOT = 16
TILE_TOKENS = 1 << 19
HELD_ROWS = 1 << 17  # pairs or hot rows that a task sums at once; the sum takes several copies of them
BROADCAST_ROWS = 1_000_000  # row keys of 8 bytes; more of them are joined by a shuffle
CLASS_ROW = 31  # code of rows that describe a class in place of a scheme
_LOW = np.uint64(31)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; of all its words, if they are fewer."""
    from xxhash import xxh3_64_intdigest

    parts = text.encode("utf-8", "replace").lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out *= _GOLD
        out += h[k : k + n]
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))


def set_key(tokens: np.ndarray) -> int:
    """64-bit key of a set, as a signed number."""
    parts = np.append(mix(tokens + np.uint64(7)), np.array([len(tokens)], np.uint64) * _GOLD)
    return int(mix(parts.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def most_different(x: int, y: int, percent: int) -> int:
    """The most tokens in which linked sets of these sizes differ."""
    return (100 - percent) * (x + y) // (100 + percent)


def largest_partner(x: int, scheme: int, percent: int) -> int:
    """The largest partner of a set of ``x`` tokens whose smaller side lies in the scheme's band."""
    top = (2 << scheme) - 1
    return 100 * x // percent if x <= top else top


def schemes(x: int, percent: int) -> list[int]:
    """The scheme of the set's own band, and those below in which a smaller partner may lie."""
    own = x.bit_length() - 1
    least = -(-percent * x // 100)
    return list(range(max(0, least.bit_length() - 1), own + 1))[::-1]


def allocation(scheme: int, percent: int) -> tuple[int, bool]:
    """(number of partitions, one-deletion neighbourhoods?) of a scheme: of the ways that give the band's largest set its
    weight with six standard deviations to spare, the one with the fewest expected signatures."""
    x = (2 << scheme) - 1
    need = most_different(x, largest_partner(x, scheme, percent), percent) + 1
    best = None
    for deletions in (False, True):
        for load in (3.0, 2.6, 2.2, 2.0, 1.8, 1.6, 1.4, 1.2, 1.0, 0.8, 0.6, 0.4, 0.25):
            m = math.ceil(x / load)
            load = x / m
            filled, single = m * (1 - math.exp(-load)), m * load * math.exp(-load)
            weight = 2 * filled - single if deletions else filled
            rows = filled + (x - single if deletions else 0)
            spare = 6 * math.sqrt(m * math.exp(-load) * (1 - math.exp(-load)))
            if weight - spare * (2 if deletions else 1) >= need and (best is None or rows < best[0]):
                best = (rows, m, deletions)
    return best[1:] if best else (8 * x, True)


def signatures(tokens: np.ndarray, scheme: int, partitions: int, deletions: bool) -> tuple[np.ndarray, int]:
    """Signatures of a set in a scheme (the scheme in the lowest bits), and the weight they carry."""
    part = ((mix(tokens ^ np.uint64(0xA5A5A5A5)) >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    part, value = part[order], mix(tokens[order])
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    sums = np.add.reduceat(value, starts)
    tag = part * _GOLD + np.uint64(scheme)
    made = mix(sums ^ tag[starts])
    weight = len(starts)
    if deletions:
        sizes = np.diff(np.append(starts, len(part)))
        less = np.repeat(sums, sizes) - value
        several = np.repeat(sizes > 1, sizes)
        made = np.unique(np.concatenate([made, mix(less[several] ^ tag[several])]))
        weight = int(np.minimum(sizes, 2).sum())
    return (made & ~_LOW) | np.uint64(scheme), weight


def _signed(df: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """(sig, key, a, b, c, d): the signatures of all classes, and one row for each document that describes its class.

    A class that occurs again within a task signs once. Rows about documents go to their row key's partition.
    """
    rows = df.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(doc_id, text).alias("rid"), F.col(text).alias("text"))
    plans = [allocation(k, percent) for k in range(CLASS_ROW)]
    schema = pa.schema([(n, pa.int64()) for n in ("sig", "key", "a", "b", "c", "d")])

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            sigs, keys, about = [], [], []
            held = 0
            for doc, rid, body in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = shingles(body, words)
                key = set_key(tokens)
                counts = [0, 0]
                if len(tokens):
                    for j, k in enumerate(schemes(len(tokens), percent)):
                        made, counts[j] = signatures(tokens, k, *plans[k])
                        if key not in seen:
                            sigs.append(made)
                            keys.append((key, len(made)))
                            held += len(made)
                    seen.add(key)
                about.append((rid & ~31 | CLASS_ROW, key, doc, rid, len(tokens), counts[0] << 32 | counts[1]))
                if held > 1 << 18 or len(about) > 5000:
                    yield _sheet(sigs, keys, about, schema)
                    sigs, keys, about, held = [], [], [], 0
                if len(seen) > 1 << 20:
                    seen.clear()
            yield _sheet(sigs, keys, about, schema)

    return rows.mapInArrow(run, "sig bigint, key bigint, a bigint, b bigint, c bigint, d bigint")


def _sheet(sigs, keys, about, schema) -> pa.RecordBatch:
    sig = np.concatenate(sigs).view(np.int64) if sigs else np.zeros(0, np.int64)
    key = np.repeat(np.array([k for k, _ in keys], np.int64), [n for _, n in keys])
    none = pa.nulls(len(sig), pa.int64())
    first = [pa.array(sig), pa.array(key), none, none, none, none]
    last = [pa.array(x, pa.int64()) for x in zip(*about)] if about else [pa.array([], pa.int64())] * 6
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(first, last)], schema=schema)


def _grouped(signed: DataFrame, hot: int) -> DataFrame:
    """What the groups of equal signatures say, as (kind, a, b, c, d, key).

    ``class`` rows as they came; ``pair``: classes a < b share c signatures of scheme d within small groups, counted by
    task; ``hot``: class b has c signatures of scheme d that more than ``hot`` classes share, a being the smallest of
    them. Near copies share nearly all their smallest classes, so these rows are few for each class of a large group.
    """
    rows = signed.repartition("sig").sortWithinPartitions("sig", "key")
    target = pa.schema([("kind", pa.string())] + [(n, pa.int64()) for n in ("a", "b", "c", "d", "key")])

    def made(kind, a, b, c, d, key=None):
        key = pa.nulls(len(a), pa.int64()) if key is None else key
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(a)), *(pa.array(x, pa.int64()) for x in (a, b, c, d)), pa.array(key, pa.int64())], schema=target)

    def run(batches):
        tail = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        known = None  # signature and smallest class of an open group whose first rows are out already
        pairs: list[np.ndarray] = []
        stars: list[np.ndarray] = []

        def close(sig, key):
            """Pairs and hot rows of whole groups, and of the rest of a group that is known."""
            if not len(sig):
                return
            fresh = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]))  # a class may sign from several tasks
            sig, key = sig[fresh], key[fresh]
            starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            sizes = np.diff(np.append(starts, len(sig)))
            least, large = key[starts], sizes > hot
            if known is not None and sig[0] == known[0]:
                least[0], large[0] = known[1], True
            for size in np.unique(sizes[(sizes > 1) & ~large]):
                at = starts[(sizes == size) & ~large]
                for i in range(size):
                    for j in range(i):
                        pairs.append(np.stack([key[at + j], key[at + i], sig[at] & 31]))
            many = np.repeat(large, sizes)
            if many.any():
                stars.append(np.stack([np.repeat(least, sizes)[many], key[many], sig[many] & 31]))
            for kind, held in (("pair", pairs), ("hot", stars)):
                if sum(p.shape[1] for p in held) > HELD_ROWS:
                    yield from told(kind, held)

        def told(kind, held):
            if held:
                rows = np.concatenate(held, axis=1)
                held.clear()
                rows = rows[:, np.lexsort(rows)]
                starts = np.flatnonzero(np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)))
                both = rows[:, starts]
                yield made(kind, both[0], both[1], np.diff(np.append(starts, rows.shape[1])), both[2])

        for batch in batches:
            table = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
            about = (table[0] & 31) == CLASS_ROW
            if about.any():
                mask = pa.array(about)
                part = batch.filter(mask)
                yield made("class", part.column(2), part.column(3), part.column(4), part.column(5), part.column(1))
            sig = np.concatenate([tail[0], table[0][~about]])
            key = np.concatenate([tail[1], table[1][~about]])
            # The last group may go on in the next batch; of a group that is surely hot no row has to wait.
            cut = int(np.searchsorted(sig, sig[-1])) if len(sig) else 0
            yield from close(sig[:cut], key[:cut])
            tail = (sig[cut:], key[cut:])
            if len(np.unique(tail[1])) > hot:
                if known is None or known[0] != tail[0][0]:
                    known = (tail[0][0], tail[1][0])
                yield from close(*tail)
                tail = (tail[0][:0], tail[1][:0])
        yield from close(*tail)
        yield from told("pair", pairs)
        yield from told("hot", stars)

    return rows.mapInArrow(run, "kind string, a bigint, b bigint, c bigint, d bigint, key bigint")


def _tile_links(group, percent: int):
    """Spanning forest of the true links among the sets of one tile, as arrays of smaller and larger keys."""
    keys = group.column("key").to_numpy()
    sides = group.column("side").to_numpy()
    lists = group.column("tokens").combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy()[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(keys)), sizes)
    order = np.argsort(token, kind="stable")
    posted = owner[order]
    starts = np.cumsum(times) - times
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(keys)):
        mine = token[offsets[i] : offsets[i + 1]]
        mine = mine[times[mine] > 1]
        if not len(mine):
            continue
        lengths = times[mine]
        shift = starts[mine] - (np.cumsum(lengths) - lengths)
        common = np.bincount(posted[np.repeat(shift, lengths) + np.arange(lengths.sum())], minlength=len(keys))
        near = 100 * common >= percent * (sizes[i] + sizes - common)
        near[: i + 1] = False
        for j in np.flatnonzero(near):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(keys))])
    moved = np.flatnonzero(roots != np.arange(len(keys)))
    return keys[roots[moved]], keys[moved]


def link(df: DataFrame, doc_id: str, text: str, words: int = WORDS, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """One row a document: ``id``, ``rid`` (a hash of id and text), ``n_shingles``, ``class_key``, ``component``, ``group_key``.

    ``component`` is the smallest id that links of similarity of at least ``percent`` / 100 reach, the own one included.
    """
    if not 50 <= percent <= 100:
        raise ValueError("a similarity of 50 to 100 percent is asked for, so that a set has at most two schemes")
    folder = work_folder(df.sparkSession, "jaccard")
    found = stored(_grouped(_signed(df, doc_id, text, words, percent), hot), f"{folder}/groups")
    docs = found.where("kind = 'class'").select("key", F.col("a").alias("id"), F.col("b").alias("rid"), F.col("c").alias("n"), "d")
    classes = docs.where("n > 0").groupBy("key").agg(F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("d").alias("d"))
    classes = stored(classes, f"{folder}/classes")

    # Weight of each class in its schemes, without hot signatures.
    own = F.floor(F.log2(F.col("n") + 0.5)).cast("bigint")
    weights = classes.select("key", "n", F.explode(F.array(F.struct(own.alias("scheme"), F.shiftright("d", 32).alias("w")), F.struct((own - 1).alias("scheme"), F.col("d").bitwiseAND(0xFFFFFFFF).alias("w")))).alias("s"))
    weights = weights.select("key", "n", "s.scheme", "s.w").where("w > 0")
    plans = [allocation(k, percent) for k in range(CLASS_ROW)]
    deleting = F.col("scheme").isin([k for k, (_, deletions) in enumerate(plans) if deletions])
    hots = found.where("kind = 'hot'").groupBy("a", F.col("b").alias("key"), F.col("d").alias("scheme")).agg(F.sum("c").alias("n"))
    hots = stored(hots, f"{folder}/hot")
    lost = hots.groupBy("key", "scheme").agg(F.sum("n").alias("lost"))
    top = F.expr("shiftleft(2L, cast(scheme AS int))") - 1
    partner = F.when(F.col("n") <= top, F.floor(100 * F.col("n") / percent)).otherwise(top)
    need = F.floor((100 - percent) * (F.col("n") + partner) / (100 + percent)) + 1
    cost = F.when(deleting, 2).otherwise(1) * F.coalesce("lost", F.lit(0))
    weights = weights.join(lost, ["key", "scheme"], "left").select("key", "scheme", "n", F.col("w").alias("all"), (F.col("w") - cost).alias("w"), need.alias("need"), deleting.alias("deleting"))
    weights = stored(weights, f"{folder}/weights")

    pairs = found.where("kind = 'pair'").groupBy("a", "b", F.col("d").alias("scheme")).agg(F.sum("c").alias("shared"))
    side = lambda x: weights.select(F.col("key").alias(x), "scheme", F.col("n").alias(f"n{x}"), F.col("w").alias(f"w{x}"), F.col("deleting").alias(f"e{x}"))
    pairs = pairs.join(side("a"), ["a", "scheme"]).join(side("b"), ["b", "scheme"])
    differ = F.floor((100 - percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    enough = F.col("ea") | ((F.col("shared") >= F.col("wa") - differ) & (F.col("shared") >= F.col("wb") - differ))
    light = pairs.where(fits & enough).select("a", "b")

    heavy = weights.where("w < need")
    stars = hots.join(heavy.select("key", "scheme"), ["key", "scheme"], "left_semi").select("a", F.col("key").alias("b"))
    # A class whose segments carry too little weight from the start meets the others of its scheme.
    short = heavy.where(F.col("all") < F.col("need"))
    firsts = short.groupBy("scheme").agg(F.min("key").alias("a"))
    meet = short.join(firsts, "scheme").select("a", F.col("key").alias("b"))
    coarse = components(light.unionByName(stars).unionByName(meet), f"{folder}/coarse")

    # Sets of the classes in coarse groups, dealt into tiles of bounded numbers of tokens.
    members = coarse.select(F.col("node").alias("key"), F.col("label").alias("cell")).join(classes.select("key", "rid", "n"), "key")
    members = stored(members, f"{folder}/members")
    sizes = members.groupBy("cell").agg(F.ceil(F.sum("n") / TILE_TOKENS).cast("int").alias("blocks"))
    placed = members.join(stored(sizes, f"{folder}/cells"), "cell")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    wanted = placed.select("rid", "key", "cell", "blocks", "block")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = df.select(F.xxhash64(doc_id, text).alias("rid"), F.col(text).alias("text")).join(wanted, "rid")

    def build(batches):
        names = ["key", "cell", "blocks", "block", "tokens"]
        for batch in batches:
            rows, held = [], 0
            for body, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((*rest, shingles(body, words).view(np.int64)))
                held += len(rows[-1][-1])
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*rows)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*rows)], names=names)

    sets = texts.select("text", "key", "cell", F.col("blocks").cast("bigint"), F.col("block").cast("bigint"))
    sets = sets.mapInArrow(build, "key bigint, cell bigint, blocks bigint, block bigint, tokens array<bigint>")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    tiled = sets.withColumn("other", other).select(
        "key", "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.lit(0).alias("side"), "tokens"
    )

    def verify(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        _, first = np.unique(keys, return_index=True)  # the row that stands for a class may repeat
        a, b = _tile_links(group.take(pa.array(first)), percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = tiled.groupBy("cell", "low", "high").applyInArrow(verify, "a bigint, b bigint")
    groups = components(stored(links, f"{folder}/links"), f"{folder}/fine")

    ids = docs.where("n > 0").groupBy("key").agg(F.min("id").alias("id"))
    named = ids.join(groups.select(F.col("node").alias("key"), "label"), "key", "left")
    named = stored(named.select("key", "id", F.coalesce("label", "key").alias("label")), f"{folder}/named")
    least = stored(named.groupBy("label").agg(F.min("id").alias("component")), f"{folder}/least")
    final = stored(named.join(least, "label").select("key", "component", "label"), f"{folder}/final")
    out = docs.join(final, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select("id", "rid", F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), component.alias("component"), F.col("label").alias("group_key"))
