"""Best-fit packing of tokenised documents by hierarchical residual rounds.

Documents are tokenised once, cut into pieces of at most ``capacity`` tokens, and
the pieces' lengths packed: each group of items is packed best-fit, largest first;
bins that are nearly full are final, the others become the items of the next round,
in fewer and fewer groups, until one group is left or a round merges next to
nothing. A bin carries its pieces along, at most ``capacity`` of them, so no round
joins anything. Groups are bounded by ``GROUP`` items: no task holds more, whatever
the input.

Null texts are empty; a document always has its end token. Documents with a null or
repeated id are packed like any other. Extra columns are ignored.
"""

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadlens.session import snapshot

CAPACITY = 2048
GROUP = 50_000
# Bins with at most this much room left are final at once.
SLACK = 8
# A further round must save at least this share of the bins it gets.
GAIN = 0.002
END_TOKEN = 0
CACHED_WORDS = 600_000

# Texts with these go to the tokenizer as they are: letters whose lower case depends
# on the place or is longer, separators that only Python takes for white space, and
# what may be a special token.
_AS_IS = re.compile("[\x1c-\x1fΣİ]|<\\|")
_TAILS = frozenset(".,;:!?")
# A stop or comma after other punctuation belongs to the same run and stays with it.
_RUN = re.compile(r"(?:[^\s\w]|_)[.,]\s")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte (as a code point).

    Printable bytes stand for themselves, the others for 256 and upwards in order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(256 + n) for n, b in enumerate(others)}


_LETTERS = _byte_letters()


class WordEncoder:
    """Token ids as little-endian 32-bit bytes; the ids of words are kept and reused.

    The tokenizer drops white space, splits runs of letters from punctuation and
    ignores case, so a text's ids are those of its lower-case words in a row.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for text in texts:
            if not text:
                yield b""
            elif _AS_IS.search(text) or not unicodedata.is_normalized("NFC", text):
                yield self._ids(text)
            else:
                given, text = text, text.lower()
                # Some marks combine with a small letter only, after the tokenizer's own NFC.
                if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                    yield self._ids(given)
                    continue
                if not _RUN.search(text):
                    text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ")
                words = text.split()
                try:
                    yield b"".join(map(self.known.__getitem__, words))
                except KeyError:
                    self._learn(set(words))
                    yield b"".join(map(self.known.__getitem__, words))

    def _ids(self, text: str) -> bytes:
        return np.array(
            self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4"
        ).tobytes()

    def _learn(self, words: set[str]) -> None:
        known = self.known
        if len(known) + len(words) > CACHED_WORDS:
            known.clear()
        new = {w for w in words if w not in known}
        ended = {w for w in new if w[-1] in _TAILS and w[:-1].isalpha()}
        plain = {w for w in {w[:-1] for w in ended}.union(new - ended) if w not in known}
        alone = [w for w in plain if w.isalpha()]
        for word in plain.difference(alone):
            known[word] = self._ids(word)
        # A run of letters is one word to the model.
        for word in alone:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            ids = [token.id for token in self.model.tokenize(letters)]
            known[word] = struct.pack(f"<{len(ids)}I", *ids)
        for word in ended:
            tail = word[-1]
            if tail not in known:
                known[tail] = self._ids(tail)
            known[word] = known[word[:-1]] + known[tail]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


PIECE = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY,
           keep_ids: bool = False) -> DataFrame:
    """The pieces of every document, with their token ids if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end_token = np.array([END_TOKEN], dtype="<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, spans, ids = [], [], []
                for row, encoded in enumerate(encoder.encode(batch.column(1).to_pylist())):
                    tokens = encoded + end_token
                    for n, first in enumerate(range(0, len(tokens), 4 * capacity)):
                        own = tokens[first:first + 4 * capacity]
                        rows.append(row)
                        spans.append((n, first // 4, len(own) // 4, zlib.crc32(own)))
                        if keep_ids:
                            ids.append(np.frombuffer(own, dtype="<u4").astype(np.int32))
                numbers = np.array(spans, dtype=np.int64).reshape(-1, 4).T
                columns = [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(numbers[0].astype(np.int32)), *map(pa.array, numbers[1:]),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECE + (", ids ARRAY<INT>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


# --- packing ----------------------------------------------------------------------


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item; items are taken in the given order, into the fullest bin
    that still has room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin with room r is open
    bins, opened = [], 0
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, own = capacity, opened
            opened += 1
        bins.append(own)
        left = room - length
        if left:
            by_room[left].append(own)
            rooms |= 1 << left
    return bins


def _round(items: DataFrame, groups: int, number: int, capacity: int) -> DataFrame:
    """Pack (fill, members) rows within each of ``groups`` groups."""
    kind = items.schema["members"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fills = table.column("fill").to_numpy()
        order = np.lexsort((table.column("tie").to_numpy(), -fills))
        bins = np.array(best_fit(fills[order].tolist(), capacity), dtype=np.int64)
        # Items by bin, in the order they were put in; their members follow each other.
        taken = order[np.argsort(bins, kind="stable")]
        sorted_bins = np.sort(bins)
        count = int(sorted_bins[-1]) + 1
        members = pa.concat_arrays(table.column("members").take(pa.array(taken)).chunks)
        sizes = np.bincount(sorted_bins, members.value_lengths().to_numpy(), count)
        offsets = np.zeros(count + 1, dtype=np.int32)
        offsets[1:] = np.cumsum(sizes)
        filled = np.bincount(sorted_bins, fills[taken], count).astype(np.int64)
        numbers = (number << 54) + (key[0].as_py() << 24) + np.arange(count)
        return pa.table({
            "sequence_id": numbers,
            "fill": filled,
            "members": pa.ListArray.from_arrays(pa.array(offsets), members.flatten()),
        })

    # Equal pieces differ by their place, so that they are dealt out like any others.
    place = F.monotonically_increasing_id()
    dealt = items.withColumn("tie", F.xxhash64("members", place)).withColumn(
        "_group", F.pmod(F.xxhash64("tie", F.lit(number)), F.lit(groups)).cast("int")
    )
    return dealt.groupBy("_group").applyInArrow(
        run, f"sequence_id BIGINT, fill BIGINT, members {kind}"
    )


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The rows of a stored table of pieces with ``sequence_id`` and ``offset``."""
    columns = parts.columns
    full = parts.where(F.col("length") == capacity).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    items = parts.where(F.col("length") < capacity).select(
        F.col("length").alias("fill"), F.array(F.struct(*columns)).alias("members")
    )
    waiting, number, done = items.count(), 0, []
    while waiting:
        groups = -(-waiting // group)
        packed = snapshot(_round(items, groups, number, capacity), "packed-bins")
        open_bins = packed.where(F.col("fill") < capacity - SLACK)
        left = open_bins.count()
        last = groups == 1 or (number > 0 and left > waiting * (1 - GAIN))
        done.append(packed if last else packed.where(F.col("fill") >= capacity - SLACK))
        if last:
            break
        # Fewer groups in each round, so that bins of different groups meet.
        items, waiting, number = open_bins.select("fill", "members"), left, number + 1
    if not done:
        return full
    bins = reduce(DataFrame.unionByName, done)
    inner = bins.select(
        "sequence_id", F.posexplode("members").alias("_at", "_member"),
        F.transform("members", lambda m: m["length"]).alias("_lengths"),
    )
    placed = inner.select(
        "_member.*", "sequence_id",
        F.aggregate(
            F.slice("_lengths", F.lit(1), F.col("_at")), F.lit(0).cast("bigint"), lambda a, b: a + b
        ).alias("offset"),
    )
    return full.unionByName(placed)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    return pack(snapshot(pieces(docs, tokenizer, capacity), "pieces"), capacity)
