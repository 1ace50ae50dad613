"""Interpolated modified Kneser-Ney model of any order: counted in Spark, stored as sorted hash arrays, memory-mapped for scoring."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _REMEMBERED, add_columns, arrow_schema, drop_shuffles, materialise, mix, named, new_path, release, tidy, to_batch
from .store import get, narrow, pack_sorted, planes, put, unpack_sorted, unplanes

#: Ends every text and comes before its first word, as often as the order needs; no word holds white space.
END = b" "
_PART = 1 << 20
_BLANKS = b" \t\n\v\f\r"
UNKNOWN = np.int64(-1)
#: Tokens that are looked up together; tokens whose n-grams a task counts before it passes them on.
CHUNK, HOLD = 200_000, 1_200_000
_STEP = np.uint64(0xD1342543DE82EF95)
#: What is known of a context: the sum of its counts, and how many words follow it that are counted once, twice, more often.
STATS = 4


def word_parts(text: str) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in parts of bounded size."""
    data = text.encode().lower()
    at = 0
    while at < len(data):
        to = at + _PART
        while to < len(data) and data[to] not in _BLANKS:
            to += 1
        yield data[at:to].split()
        at = to


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


@dataclass
class Model:
    """What scoring needs besides the mapped arrays: their folder, how they are divided, totals and discounts."""

    folder: str
    order: int
    bits: int  # vocabulary shards by the hash's first bits
    starts: np.ndarray  # first id of each vocabulary shard
    shards: int  # of n-grams
    tokens: int
    vocabulary: int
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)  # by level
    present: dict[int, np.ndarray] = field(default_factory=dict)  # by level, the shards that hold something
    pairs: int = 0  # different pairs of words
    lower_rest: float = 1.0  # share of the unigram level that goes to all words alike


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more from the numbers of types seen 1 to 4 times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(float(min(max(d, 0.05), k - 0.05)) for k, d in enumerate((d1, d2, d3), 1))


class Vocabulary:
    """Word to id, from mapped sorted hash arrays; recent answers are remembered up to a bound."""

    LIMIT = 400_000

    def __init__(self, folder: str, bits: int, starts: np.ndarray):
        self.folder, self.bits, self.starts = folder, bits, starts
        self.shards: dict[int, np.ndarray] = {}
        self.known: dict[bytes, int] = {}

    def find(self, words: list[bytes]) -> np.ndarray:
        h = hashes(words)
        order = np.argsort(h)
        out, h = np.full(len(h), UNKNOWN), h[order]
        tops = (h >> np.uint64(64 - self.bits)).astype(int) if self.bits else np.zeros(len(h), int)
        for top in np.unique(tops):
            a, b = np.searchsorted(tops, [top, top + 1])
            if top not in self.shards:
                self.shards[top] = get(self.folder, f"words-{top}")
            shard = self.shards[top]
            at = np.searchsorted(shard, h[a:b])
            hit = at < len(shard)
            hit[hit] = shard[at[hit]] == h[a:b][hit]
            out[order[a:b][hit]] = self.starts[top] + at[hit]
        return out

    def ids(self, words: list[bytes]) -> np.ndarray:
        got = np.fromiter(map(self.known.get, words, repeat(-2)), np.int64, len(words))
        missing = np.flatnonzero(got == -2)
        if len(missing):
            new = list({words[k] for k in missing})
            if len(self.known) + len(new) > self.LIMIT:
                self.known.clear()
            fresh = dict(zip(new, self.find(new).tolist(), strict=True))
            self.known.update(fresh)
            got[missing] = [fresh[words[k]] for k in missing]
        return got


_VOCABULARIES: dict[str, Vocabulary] = {}
_REMEMBERED.append(_VOCABULARIES)


def vocabulary(folder: str, bits: int, starts: np.ndarray) -> Vocabulary:
    """One for each model and process."""
    if folder not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[folder] = Vocabulary(folder, bits, starts)
    return _VOCABULARIES[folder]


def chunks(texts: Iterator[str]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, text number of each): texts in order with an END after each, in chunks of about CHUNK words; a text may go on in the next."""
    words, owners = [], []
    for k, text in enumerate(texts):
        for part in word_parts(text):
            words += part
            owners.append((k, len(part)))
            if len(words) >= CHUNK:
                yield words, np.repeat(*np.array(owners).T)
                words, owners = [], []
        words.append(END)
        owners.append((k, 1))
    if words:
        yield words, np.repeat(*np.array(owners).T)


def _texts(frame: pa.RecordBatch) -> Iterator[str]:
    return (x.as_py() for x in frame.column(frame.num_columns - 1))


def _count_words(texts: DataFrame, folder: str, bits: int) -> tuple[np.ndarray, int]:
    """Write sorted hashes and counts of the words by shard; (first id of each shard and the total, all tokens)."""
    schema = "shard int, hashes binary, counts binary"
    arrow = arrow_schema(schema)

    def flush(counter: Counter) -> pa.RecordBatch:
        h = hashes(list(counter))
        order = np.argsort(h)
        h, n = h[order], np.fromiter(counter.values(), np.uint64, len(counter))[order]
        edges = np.searchsorted(h, [np.uint64(k << (64 - bits)) for k in range(1 << bits)] if bits else [0]).tolist() + [len(h)]
        return to_batch([(k, pack_sorted(h[a:b]), planes(n[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a], arrow)

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for frame in frames:
            for text in _texts(frame):
                for part in word_parts(text):
                    counter.update(part)
                counter[END] += 1
                if len(counter) > 700_000:
                    yield flush(counter)
                    counter = Counter()
        if counter:
            yield flush(counter)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        h = np.concatenate([unpack_sorted(x.as_py()) for x in table.column("hashes")])
        n = np.concatenate([unplanes(x.as_py(), "<u8") for x in table.column("counts")])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        n = np.add.reduceat(n, first)
        put(folder, f"words-{key[0].as_py()}", h[first])
        put(folder, f"counts-{key[0].as_py()}", n)
        return pa.table({"shard": [key[0].as_py()], "words": [len(first)], "tokens": [int(n.sum())]}, schema=told)

    told = arrow_schema("shard int, words long, tokens long")
    done = texts.mapInArrow(count, schema).groupBy("shard").applyInArrow(merge, "shard int, words long, tokens long").toArrow().to_pylist()
    sizes = np.zeros(1 << bits, np.int64)
    for x in done:
        sizes[x["shard"]] = x["words"]
    for k in np.flatnonzero(sizes == 0):
        put(folder, f"words-{k}", np.empty(0, np.uint64))
        put(folder, f"counts-{k}", np.empty(0, np.uint64))
    return np.r_[0, np.cumsum(sizes)], sum(x["tokens"] for x in done)


class Keys:
    """N-grams of word ids as rows of unsigned 64-bit integers that sort as the columns do: the first row holds as many columns as fit, others one each."""

    def __init__(self, vocabulary: int, columns: int):
        self.width = max(1, vocabulary.bit_length())
        self.first = min(columns, 64 // self.width)
        self.rows = 1 + columns - self.first

    def pack(self, columns: list[np.ndarray]) -> np.ndarray:
        out = columns[0].astype(np.uint64)
        for c in columns[1 : self.first]:
            out = out << np.uint64(self.width) | c.astype(np.uint64)
        return np.stack([out, *(c.astype(np.uint64) for c in columns[self.first :])])

    def unpack(self, keys: np.ndarray) -> list[np.ndarray]:
        low = np.uint64((1 << self.width) - 1)
        return [*(keys[0] >> np.uint64(self.width * k) & low for k in range(self.first - 1, -1, -1)), *keys[1:]]

    def combine(self, keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted different keys and the sums of their counts ``n``, 1 each if not given."""
        if not keys.shape[1]:
            return keys, np.empty(0, np.uint64)
        if self.rows == 1 and n is None:
            keys = np.sort(keys, axis=1)
        else:
            one = keys[0]
            for k in keys[1:]:  # the rank of what is before, with a column behind it
                one = np.unique(one, return_inverse=True)[1].astype(np.uint64) << np.uint64(self.width) | k
            order = np.argsort(one)
            keys, n = keys[:, order], None if n is None else n[order]
        first = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        sums = np.diff(np.r_[first, keys.shape[1]]) if n is None else np.add.reduceat(n, first)
        return keys[:, first], sums.astype(np.uint64)

    def to_bytes(self, keys: np.ndarray) -> bytes:
        """Of sorted keys: the first row as differences."""
        return b"".join([pack_sorted(keys[0]), *map(planes, keys[1:])])

    def from_bytes(self, data: bytes) -> np.ndarray:
        size = len(data) // self.rows
        return np.stack([unpack_sorted(data[:size]), *(unplanes(data[k * size : (k + 1) * size], "<u8") for k in range(1, self.rows))])


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """64 bits for each n-gram, given as its words' ids from the first to the last; that of its context is met on the way."""
    out = mix(words[0].astype(np.uint64))
    for w in words[1:]:
        out = mix(out * _STEP + w.astype(np.uint64))
    return out


def _histories(ids: np.ndarray, last: np.ndarray, order: int, end: int) -> list[np.ndarray]:
    """Columns of the n-gram that ends in each word, from the last word back; what is before a text is END."""
    stream, n, columns = np.r_[last, ids], len(ids), [ids]
    for k in range(1, order):
        before = stream[order - 1 - k : order - 1 - k + n]
        columns.append(before if k == 1 else np.where(columns[-1] == end, end, before))
    return columns


def _shard(context: np.ndarray, before: np.ndarray, counts: np.ndarray, tokens: int, shards: int) -> np.ndarray:
    """Where n-grams lie whose last context word is ``context``: with it alone, or, if it is frequent, by the word ``before`` it as well."""
    pieces = np.ceil(counts.astype(float) * shards / tokens).astype(np.uint64)
    piece = mix(before.astype(np.uint64)) % np.maximum(pieces, np.uint64(1))
    return (mix(mix(context.astype(np.uint64)) + piece) % np.uint64(shards)).astype(np.int64)


def write_hashed(folder: str, name: str, hashed: np.ndarray) -> np.ndarray:
    """Write a sorted array of hashes as buckets of their first bits, about 8 in each, and the next 32 bits; the order of the values.

    With the bits that say the shard, some 60 of the 64 count: of a thousand million n-grams, about one is taken for another.
    """
    bits = max(0, len(hashed).bit_length() - 3)
    order = np.argsort(hashed)
    hashed = hashed[order]
    top = hashed >> np.uint64(64 - bits) if bits else np.zeros(len(hashed), np.uint64)
    put(folder, f"{name}-buckets", narrow(np.searchsorted(top, np.arange((1 << bits) + 1, dtype=np.uint64))))
    put(folder, f"{name}-rest", (hashed << np.uint64(bits) >> np.uint64(32)).astype(np.uint32))
    return order


def find_hashed(buckets: np.ndarray, rest: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each hash, whether it is there): by halving within the bucket, all at once."""
    bits = (len(buckets) - 1).bit_length() - 1
    top = (hashed >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashed), np.int64)
    want = (hashed << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
    if not len(rest):
        return np.zeros(len(hashed), np.int64), np.zeros(len(hashed), bool)
    low, stop = buckets[top].astype(np.int64), buckets[top + 1].astype(np.int64)
    for k in range(int((stop - low).max(initial=0)).bit_length() - 1, -1, -1):  # past 2**k values, if all of them are smaller
        last = low + ((1 << k) - 1)
        low += ((last < stop) & (rest.take(last, mode="clip") < want)).astype(np.int64) << k
    at = np.minimum(low, len(rest) - 1)
    return at, (low < stop) & (rest[at] == want)


def _write_grams(folder: str, level: int, shard: int, hashed: np.ndarray, n: np.ndarray) -> None:
    put(folder, f"grams{level}-{shard}-counts", narrow(n[write_hashed(folder, f"grams{level}-{shard}", hashed)]))


def _write_level(folder: str, level: int, shard: int, words: list[np.ndarray], n: np.ndarray) -> list[int]:
    """Write a level's sorted n-grams, given as columns from the last context word back and then the last word, and what their contexts saw; the numbers of n-grams and of those counted 1 to 4 times."""
    context = words[-2::-1]
    h = gram_hash(context)
    _write_grams(folder, level, shard, mix(h * _STEP + words[-1]), n)
    first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in context], axis=0)])
    stats = np.stack([np.add.reduceat(x.astype(np.uint64), first) for x in (n, n == 1, n == 2, n >= 3)], axis=1)
    order = write_hashed(folder, f"contexts{level}-{shard}", h[first])
    stats, code = stats[order], np.zeros(len(stats), np.uint64)
    more = np.flatnonzero(stats[:, 0] > 1)  # the others have one word, once
    _, at, kind = np.unique(gram_hash(list(stats[more].T)), return_index=True, return_inverse=True)
    code[more] = kind + 1
    put(folder, f"contexts{level}-{shard}-kinds", np.concatenate([np.array([[1, 1, 0, 0]], np.uint64), stats[more[at]]]))
    put(folder, f"contexts{level}-{shard}-code", narrow(code))
    return [len(n), *(int((n == k).sum()) for k in (1, 2, 3, 4))]


_PAIRS = "shard int, keys binary, counts binary"
_TYPES = "level int, place int, types array<long>"


def _by_shard(keys: np.ndarray, n: np.ndarray, shard: np.ndarray, coder: Keys) -> list[tuple]:
    """Rows (shard, keys, counts) of sorted keys."""
    order = np.argsort(shard.astype(np.min_scalar_type(int(shard.max(initial=0)))), kind="stable")
    keys, n, shard = keys[:, order], n[order], shard[order]
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
    return [(int(shard[a]), coder.to_bytes(keys[:, a:b]), planes(n[a:b])) for a, b in zip(first, [*first[1:], len(shard)], strict=True)]


def _pairs_by_shard(keys: np.ndarray, n: np.ndarray, coder: Keys, shards: int) -> list[tuple]:
    return _by_shard(keys, n, (gram_hash(coder.unpack(keys)) % np.uint64(shards)).astype(np.int64), coder)


def _gathered(table: pa.Table, coder: Keys) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([coder.from_bytes(x.as_py()) for x in table.column("keys")], axis=1)
    return coder.combine(keys, np.concatenate([unplanes(x.as_py(), "<u8") for x in table.column("counts")]))


def _counts_of(folder: str, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How often the words of sorted known ids occur."""
    out, edges = np.zeros(len(ids), np.uint64), np.searchsorted(ids, starts)
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            out[a:b] = get(folder, f"counts-{k}")[ids[a:b] - starts[k]]
    return out


def _count_grams(texts: DataFrame, model: Model) -> DataFrame:
    """The n-grams of the highest order, combined in each task and dealt out: by their last context word, or pairs by their hash."""
    arrow, order, coder = arrow_schema(_PAIRS), model.order, Keys(model.vocabulary, model.order)
    folder, bits, starts, tokens, shards = model.folder, model.bits, model.starts, model.tokens, model.shards

    def deal(stream: np.ndarray, end: int) -> pa.RecordBatch:
        """Of words, with order - 1 that were before them: sorted by their ranks among themselves, which fit together more often than ids."""
        own, rank = np.unique(stream, return_inverse=True)
        columns = _histories(rank[order - 1 :], rank[: order - 1], order, int(np.searchsorted(own, end)))
        local = Keys(len(own), order)
        keys, n = local.combine(local.pack([*columns[1:], columns[0]]))
        ranks = local.unpack(keys)
        keys = coder.pack([own[r] for r in ranks])
        if order == 2:
            return to_batch(_pairs_by_shard(keys, n, coder, shards), arrow)
        counts = _counts_of(folder, starts, own)
        return to_batch(_by_shard(keys, n, _shard(own[ranks[0]], own[ranks[1]], counts[ranks[0]], tokens, shards), coder), arrow)

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(folder, bits, starts)
        tidy(_VOCABULARIES)
        end = int(words.ids([END])[0])
        held, size = [np.full(order - 1, end)], 0
        for frame in frames:
            for part, _ in chunks(_texts(frame)):
                held.append(words.ids(part))
                size += len(part)
                if size >= HOLD:
                    stream = np.concatenate(held)
                    yield deal(stream, end)
                    held, size = [stream[-(order - 1) :]], 0
        if size:
            yield deal(np.concatenate(held), end)

    return texts.mapInArrow(count, _PAIRS)


def _higher_levels(dealt: DataFrame, model: Model) -> DataFrame:
    """Write the levels from the highest to the third, shard by shard; (level, place, types), and pairs with how many words came before them."""
    folder, order, shards, coders = model.folder, model.order, model.shards, {k: Keys(model.vocabulary, k) for k in range(2, model.order + 1)}
    schema = f"{_PAIRS}, {_TYPES}"
    arrow = arrow_schema(schema)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        place, rows, coder = key[0].as_py(), [], coders[order]
        keys, n = _gathered(table, coder)
        for level in range(order, 2, -1):
            words = coder.unpack(keys)
            rows.append((None, None, None, level, place, _write_level(folder, level, place, words, n)))
            coder = coders[level - 1]
            keys, n = coder.combine(coder.pack([*words[:-2], words[-1]]))  # without its first word; each that came before it is a row
        rows += [(*r, None, None, None) for r in _pairs_by_shard(keys, n, coder, shards)]
        return pa.Table.from_batches([to_batch(rows, arrow)])

    return materialise(dealt.groupBy("shard").applyInArrow(merge, schema), "grams")


def _pair_level(pairs: DataFrame, model: Model) -> DataFrame:
    """Write the pairs; (level, place, types), and by vocabulary shard what the words of a shard of pairs saw."""
    folder, starts, coder = model.folder, model.starts, Keys(model.vocabulary, 2)
    schema = f"id_shard int, words binary, seen binary, befores binary, {_TYPES}"
    arrow = arrow_schema(schema)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        place = key[0].as_py()
        keys, n = _gathered(table, coder)
        first, second = (c.astype(np.int64) for c in coder.unpack(keys))
        _write_grams(folder, 2, place, gram_hash([first, second]), n)
        rows = [(None, None, None, None, 2, place, [len(n), *(int((n == k).sum()) for k in (1, 2, 3, 4))])]
        a = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        seen, left = np.stack([np.add.reduceat(x.astype(np.uint64), a) for x in (n, n == 1, n == 2, n >= 3)]), first[a]
        right, before = np.unique(second, return_counts=True)
        for k in range(len(starts) - 1):
            (i, j), (p, q) = np.searchsorted(left, starts[k : k + 2]), np.searchsorted(right, starts[k : k + 2])
            if j > i:
                rows.append((k, planes(left[i:j] - starts[k]), planes(seen[:, i:j].ravel()), None, None, None, None))
            if q > p:
                rows.append((k, planes(right[p:q] - starts[k]), None, planes(before[p:q].astype(np.uint64)), None, None, None))
        return pa.Table.from_batches([to_batch(rows, arrow)])

    return materialise(pairs.groupBy("shard").applyInArrow(merge, schema), "pair-words")


def _word_tables(seen: DataFrame, model: Model) -> list[int]:
    """Write, by vocabulary shard, what followed each word (STATS rows) and how many words came before it; the numbers of the latter by count."""
    folder, starts = model.folder, model.starts
    told = "n1 long, n2 long, n3 long, n4 long, n0 long"
    arrow = arrow_schema(told)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        out = np.zeros((STATS + 1, int(starts[shard + 1] - starts[shard])), np.uint64)
        for words, stats, before in zip(*(table.column(c).to_pylist() for c in ("words", "seen", "befores")), strict=True):
            at = unplanes(words, "<i8")  # ids are distinct within a row
            if stats is not None:
                out[:STATS, at] += unplanes(stats, "<u8").reshape(STATS, -1)
            else:
                out[STATS, at] += unplanes(before, "<u8")
        put(folder, f"table-{shard}", narrow(out))
        return pa.Table.from_batches([to_batch([tuple(int((out[STATS] == k).sum()) for k in (1, 2, 3, 4, 0))], arrow)])

    rows = seen.where("id_shard is not null").groupBy("id_shard").applyInArrow(merge, told)
    sums = rows.agg(*(F.sum(c) for c in ("n1", "n2", "n3", "n4", "n0"))).first()
    return [int(x or 0) for x in sums]


def _note_types(rows: DataFrame, model: Model) -> None:
    """Discounts and shards of the levels in ``rows``; a few numbers for each shard come to the driver."""
    told = rows.where("types is not null").select("level", "place", "types").toArrow().to_pylist()
    for level in {x["level"] for x in told}:
        own = [x for x in told if x["level"] == level]
        types = np.sum([x["types"] for x in own], axis=0)
        model.discounts[level] = discounts([int(x) for x in types[1:]])
        model.present[level] = np.isin(np.arange(model.shards), [x["place"] for x in own])
        if level == 2:
            model.pairs = int(types[0])


def train(documents: DataFrame, learn: Column, text: str = "text", order: int = 3) -> Model:
    """Count a model of ``order`` 2 or more over all rows where ``learn`` holds; its arrays lie in the shared folder.

    Null texts are empty and give an END; repeated rows count as often as they come; without any row the model knows no word. The highest
    level counts n-grams, the lower ones how many different words came before.

    Words are counted first and numbered by sorted hash. N-grams are combined in each task and dealt out by their last context word, so that
    what a shard holds is whole: its n-grams' counts, their contexts, and the shorter n-grams that follow from them. A frequent context
    word's n-grams are divided by the word before it, which its count decides. Pairs then go by their hash, and what follows and comes before
    each word goes by word, as sums. Numbers of shards follow the number of input partitions.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    place = documents.columns
    texts = documents.where(learn).select(F.coalesce(F.col(f"`{place[named(documents, text)]}`"), F.lit("")).alias("text"))
    spark, parts = documents.sparkSession, max(2, texts.rdd.getNumPartitions())
    bits = max(1, math.ceil(math.log2(parts)) - 1)
    folder = new_path(spark, "model")
    starts, tokens = _count_words(texts, folder, bits)
    model = Model(folder, order, bits, starts, 4 * parts, tokens, int(starts[-1]))
    if not tokens:
        return model
    dealt = _count_grams(texts, model)
    if order > 2:
        grams = _higher_levels(dealt, model)
        _note_types(grams, model)
        drop_shuffles(spark)
        seen = _pair_level(grams.where("shard is not null").select("shard", "keys", "counts"), model)
        release(grams)
    else:
        seen = _pair_level(dealt, model)
    _note_types(seen, model)
    n = _word_tables(seen, model)
    release(seen)
    drop_shuffles(spark)
    model.discounts[1] = d = discounts(n[:4])
    model.lower_rest = (d[0] * n[0] + d[1] * n[1] + d[2] * (model.vocabulary - n[0] - n[1] - n[4])) / model.pairs
    return model


class Scorer:
    """Looks up counts in the mapped arrays, many at a time."""

    def __init__(self, model: Model):
        self.model = model
        self.words = vocabulary(model.folder, model.bits, model.starts)
        self.open: dict[str, np.ndarray] = {}

    def _get(self, name: str) -> np.ndarray:
        if name not in self.open:
            self.open[name] = np.asarray(get(self.model.folder, name))
        return self.open[name]

    def of_words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and the rows of the word tables of sorted ids, 0 for unknown ones."""
        counts, table = np.zeros(len(ids)), np.zeros((STATS + 1, len(ids)))
        edges = np.searchsorted(ids, self.model.starts)
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                at = ids[a:b] - self.model.starts[k]
                counts[a:b], table[:, a:b] = self._get(f"counts-{k}")[at], self._get(f"table-{k}")[:, at]
        return counts, table

    def divide(self, level: int, shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(shard, rows of it), of the shards that hold something."""
        order = np.argsort(shard.astype(np.min_scalar_type(self.model.shards)), kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        return [(int(k), order[edges[k] : edges[k + 1]]) for k in np.flatnonzero((np.diff(edges) > 0) & self.model.present[level])]

    def grams(self, level: int, divided: list[tuple[int, np.ndarray]], hashed: np.ndarray) -> np.ndarray:
        """Counts of n-grams, 0 if unseen."""
        out = np.zeros(len(hashed))
        for k, rows in divided:
            name = f"grams{level}-{k}"
            at, hit = find_hashed(self._get(f"{name}-buckets"), self._get(f"{name}-rest"), hashed[rows])
            out[rows[hit]] = self._get(f"{name}-counts")[at[hit]]
        return out

    def contexts(self, level: int, divided: list[tuple[int, np.ndarray]], hashed: np.ndarray) -> np.ndarray:
        """STATS rows, 0 if unseen."""
        out = np.zeros((STATS, len(hashed)))
        for k, rows in divided:
            name = f"contexts{level}-{k}"
            at, hit = find_hashed(self._get(f"{name}-buckets"), self._get(f"{name}-rest"), hashed[rows])
            out[:, rows[hit]] = self._get(f"{name}-kinds")[self._get(f"{name}-code")[at[hit]]].T
        return out

    def logs(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token, given with the words before it: its training count, log10 of the base and of the model's probability."""
        m, n = self.model, len(columns[0])
        both, back = np.unique(np.r_[columns[1][:1], columns[0]], return_inverse=True)
        counts, table = self.of_words(both)
        w, u = back[1:], back[:-1]
        base = np.log10((counts + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1)))
        lower = m.lower_rest / (m.vocabulary + 1)
        if not m.tokens:
            return counts[w], base[w], np.full(n, np.log10(lower))
        cut = lambda level, x: np.maximum(x - np.r_[0.0, m.discounts[level]][np.minimum(x, 3).astype(int)], 0)
        p = (cut(1, table[STATS]) / m.pairs + lower)[w]
        for level in range(2, m.order + 1):
            context = gram_hash(columns[level - 1 : 0 : -1])
            hashed = mix(context * _STEP + columns[0].astype(np.uint64))
            if level == 2:
                divided, stats = self.divide(2, (hashed % np.uint64(m.shards)).astype(np.int64)), table[:STATS, u]
            else:
                divided = divided if level > 3 else self.divide(3, _shard(columns[1], columns[2], counts[u], m.tokens, m.shards))
                stats = self.contexts(level, divided, context)
            known = stats[0] > 0
            total = np.where(known, stats[0], 1.0)
            rest = np.where(known, (np.array(m.discounts[level]) @ stats[1:]) / total, 1.0)
            p = rest * p + np.where(known, cut(level, self.grams(level, divided, hashed)) / total, 0.0)
        return counts[w], base[w], np.log10(p)


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with n_tokens, n_known, base_score and score of each whole text; no shuffle.

    n_tokens counts the words and the END; score is the model's log10 probability of the text, base_score that of smoothed single
    words. Perplexity is ``10 ** (-score / n_tokens)``. Null texts are empty: an END alone. Repeated rows stay and have equal scores; a
    model that learned nothing takes all words for alike. Input columns of these names, in any case, are replaced; no rows give no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        m, scorer = shared.value, Scorer(shared.value)
        tidy(_VOCABULARIES)
        ids_of = scorer.words.ids if m.tokens else lambda words: np.full(len(words), UNKNOWN)
        end = int(ids_of([END])[0])

        def tell(texts: list[str | None]) -> list[pa.Array]:
            sums, last = np.zeros((4, len(texts))), np.full(m.order - 1, end)
            for words, owner in chunks(x or "" for x in texts):
                # without any model, the END is as unknown as other words, and nothing depends on what is before
                ids = ids_of(words)
                count, base, log = scorer.logs(_histories(ids, last, m.order, end))
                last = np.r_[last, ids][-(m.order - 1) :]
                for k, x in enumerate((np.ones(len(ids)), count > 0, base, log)):
                    sums[k] += np.bincount(owner, x, minlength=len(texts))
            return [pa.array(sums[0].astype(int)), pa.array(sums[1].astype(int)), pa.array(sums[2]), pa.array(sums[3])]

        return tell

    return add_columns(documents, text, "n_tokens long, n_known long, base_score double, score double", make)
