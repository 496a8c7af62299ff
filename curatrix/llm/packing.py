"""Packing (6): concatenate and cut.

First pass: every partition tokenises its documents, adds the end id to each and
writes the ids with their start inside the partition. The totals of the
partitions, one number each, become the partitions' global offsets by a prefix
sum. Second pass: each document is cut where the global stream crosses a
multiple of the sequence length; a piece is the boundary record of one document
in one sequence.

Defined cases: a null text counts as empty, and an empty text is its end id
alone. Repeated rows are packed once for each row. A text of any length is cut
into as many pieces as it needs. An empty table gives no pieces. Columns other
than the id and the text are not read, so their names cannot clash. A null id
stays null.
"""

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import col, materialize, sliced

#: Entries that a tokenising worker keeps of words it has seen.
CACHE = 300_000

_TOKENS = "part int, doc_id long, local_start long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: Texts that are not cut up: other characters than ASCII and Latin letters, or
#: white space that meets white space or an end.
_ODD = r"[^\t\n\r -~À-ÖØ-öø-ƺ]|[\t\n\r ][\t\n\r ]|[\t\n\r ]$"
_WORD_END = "([A-Za-zÀ-ƺ])([^A-Za-zÀ-ƺ\x00'])"
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ƺ]+| ?[0-9]+| ?[^\\sA-Za-z0-9À-ƺ]+|\\s")


#: Texts by which merging by rank is held against the tokenizer when a worker starts.
_PROBES = ["It's a test: we'll see 3.14, don't we?\nNew line\tand tab (x_y) [1234567890]!", "déjà vu Überraschung naïve ñandú", "aaaaaaaa the there thereabouts antidisestablishmentarianism", " lead", "a", "\n"]


class Encoder:
    """Ids of the byte-level BPE in a tokenizers JSON file.

    In a text of plain Latin letters and single white space, a word ends before
    every space, after every line end and where letters end. A batch is cut
    there, and each different piece is split by the tokenizer's pattern and
    merged by rank, where the file's merges stand in the order of their ids. Any
    other text goes to the tokenizer itself.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = _ranked(json.loads(self.tokenizer.to_str()), self.special)
        self.known: dict[str, bytes] = {}
        self.cache = cache
        if self.ranked is not None and not self._agrees():
            self.ranked = None

    def _agrees(self) -> bool:
        """Whether merging by rank gives the tokenizer's own ids; if not, all texts go to the tokenizer."""
        try:
            return all((ids == self.whole(t)).all() for t, ids in zip(_PROBES, self.batch(pa.array(_PROBES)), strict=True))
        except (AttributeError, KeyError, TypeError, ValueError):
            return False
        finally:
            self.known.clear()

    def whole(self, text: str) -> np.ndarray:
        """A text's ids, by the tokenizer alone."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha() or piece[:1] == " " and piece[1:].isalpha():
            return array("I", self.ranked.encode_single_piece(piece.encode())).tobytes()
        return array("I", [i for w in _WORDS.findall(piece) for i in self.ranked.encode_single_piece(w.encode())]).tobytes()

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null has none. It takes many times the texts' own size, so they come in slices."""
        texts = texts.fill_null("")
        if self.ranked is None:
            return [self.whole(t) for t in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, _ODD)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        pieces = pc.replace_substring(pc.if_else(odd, "", texts), " ", "\x00 ")
        pieces = pc.replace_substring_regex(pieces, _WORD_END, "\\1\x00\\2")
        pieces = pc.split_pattern(pc.replace_substring(pieces, "\n", "\n\x00"), "\x00")
        counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
        coded = pieces.flatten().dictionary_encode()
        known, ids = self.known, []
        if len(known) > self.cache:
            known.clear()
        for piece in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
            found = known.get(piece)
            if found is None:
                found = known[piece] = self._piece(piece)
            ids.append(found)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(size) - size
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        ends = np.cumsum(n)
        where = np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        stream = flat[where]
        last = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [
            self.whole(texts[i].as_py()) if strange else stream[last[i] : last[i + 1]]
            for i, strange in enumerate(odd.to_pylist())
        ]


def _ranked(file: dict, special: list[str]):
    """A merger by rank, if the file is a byte-level BPE of a known kind; else None."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or file.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    # Byte-level BPE writes printable bytes as themselves, the others from U+0100 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}
    import tiktoken

    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("ranked", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its partition, its start there, its ids with the end id.

    ``ids`` holds little-endian uint32. The result is written to the shared
    folder, so that both passes see the same partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        encoder, end = Encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for some in sliced(batch, 1):
                ids = [x.tobytes() + end for x in encoder.batch(some.column(1))]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, dtype=np.int32)), some.column(0), pa.array(starts), pa.array(n), pa.array(ids, type=pa.binary())],
                    names=["part", "doc_id", "local_start", "n", "ids"],
                )

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, _TOKENS), "tokens")


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Boundary records: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` holds the piece's ids as little-endian uint32. Only the last
    sequence can be shorter than ``length``. What reaches the driver is one
    number for each partition of the input.
    """
    tokens = tokenize(docs, tokenizer, end_id, id_col, text_col)
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    offsets, total = {}, 0
    for part, n in totals:
        offsets[part], total = total, total + n
    held = tokens.sparkSession.sparkContext.broadcast(offsets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = held.value
        for batch in (some for whole in batches for some in sliced(whole, 4)):
            out: list[list] = [[] for _ in range(7)]
            for part, doc, at, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                at += base[part]
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    for column, value in zip(out, (doc, start, size, ids[4 * start : 4 * (start + size)], n, sequence, offset)):
                        column.append(value)
                    start += size
            kinds = [pa.binary() if k == 3 else pa.int64() for k in range(7)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, type=k) for x, k in zip(out, kinds)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return tokens.mapInArrow(cut, _PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids, doc_ids, offsets).

    A group holds one sequence's pieces, so its size is bounded by the sequence
    length. ``ids`` is little-endian uint32.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pieces.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id",
        F.aggregate("p.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.offset").alias("offsets"),
    )
