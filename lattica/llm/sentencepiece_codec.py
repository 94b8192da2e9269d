"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A batch's distinct marked words are sorted, which is a depth-first walk of their trie: consecutive words share a prefix,
whose forward states (best score, last piece, where it starts) are kept on a stack and used again. Models of the unigram
kind take the best sum of scores. In models of the BPE kind, pieces may follow each other only if merging would leave them
apart, which leaves one path: that of merging. Both give the ids that the public library gives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.shared import column_or_null
from lattica.llm.text import pieces

#: Stands for a space; and a character, of no meaning by Unicode, that tells literal ones of both from these.
MARK, ESCAPE = "▁", "\ufdd0"
#: Words that a worker keeps the ids of; text that it splits at a time.
CACHE, CHUNK = 300_000, 4 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            n = number()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            at += 8 if key & 7 == 1 else 4


def _model_kind(raw: bytes) -> int:
    """Field 3 of the trainer's settings (field 2 of the file): 1 unigram (where absent), 2 BPE."""
    return next((x for k, v in _fields(raw) if k == 2 for f, x in _fields(v) if f == 3), 1)


def _check_normaliser(raw: bytes) -> None:
    """Only texts as they are, with a mark before them, are encoded: a model that calls for anything else is refused."""
    found = dict(x for k, v in _fields(raw) if k == 3 for x in _fields(v))
    trainer = dict(x for k, v in _fields(raw) if k == 2 for x in _fields(v))
    odd = [name for name, is_odd in (
        ("a table of characters", bool(found.get(2))), ("no mark before the text", found.get(3, 1) == 0), ("extra spaces removed", found.get(4, 1) == 1),
        ("spaces kept as they are", found.get(5, 1) == 0), ("marks behind words", trainer.get(24, 0) == 1),
    ) if is_odd]
    if odd:
        raise ValueError(f"the model's normaliser isn't supported: {', '.join(odd)}")


class Codec:
    """One model in one process; pickled by its path, loaded where it is used."""

    _loaded: dict[str, Codec] = {}

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = sp.get_piece_size()
        self.bpe = _model_kind(raw) == 2
        _check_normaliser(raw)
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.unk = sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if i not in special}
        self.scores = [sp.get_score(i) for i in range(n)]
        self.low = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(names) if sp.is_byte(i)}
        self.out = [b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        for b, i in self.bytes.items():
            self.out[i] = bytes([b])
        self.out[self.unk] = b"" if self.bytes else " ⁇ ".encode()
        #: Lengths of the longer pieces, longest first, by their last three characters.
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                lengths.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {c: (*sorted(x, reverse=True), 2, 1) for c, x in lengths.items()}
        inside = any(MARK in p.lstrip(MARK) for p in self.ids)
        stop = "".join(re.escape(c) for c in "\n" if not any(c in p for p in self.ids))
        # no piece goes on over a mark or a line end, so texts fall apart there
        self.split = re.compile(rf"(?:{MARK}*[^{MARK}{stop}]+|{MARK}+|[{stop}])" if stop else rf"(?:{MARK}*[^{MARK}]+|{MARK}+)") if not inside else re.compile(r"(?s).+")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.names = names
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merge(self, text: str) -> list[str]:
        """Plain merging: the neighbours whose piece scores highest, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _apart(self, a: int, b: int) -> bool:
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            ok = self.pairs[key] = self.merge(self.names[a] + self.names[b]) == [self.names[a], self.names[b]]
        return ok

    def _single(self, a: int) -> bool:
        ok = self.whole.get(a)
        if ok is None:
            ok = self.whole[a] = len(self.merge(self.names[a])) == 1
        return ok

    def _fallback(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()] if self.bytes else [self.unk]

    def words(self, words: set[str]) -> None:
        """Puts the ids of these distinct words into the cache, walking their trie depth-first."""
        ids, scores, lengths, bpe, apart, single = self.ids, self.scores, self.lengths, self.bpe, self._apart, self._single
        before = ""
        best, last, back = [0.0], [-1], [0]  # by prefix length; last -2: a character without a piece
        for word in sorted(words):
            same = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                same += 1
            del best[same + 1 :], last[same + 1 :], back[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                top, piece, start = -1e300, -3, end - 1
                for n in lengths.get(word[end - 3 : end], (2, 1)) if end > 2 else (2, 1):
                    if n > end:
                        continue
                    k = ids.get(word[end - n : end])
                    if k is None:
                        continue
                    s = best[end - n] + scores[k]
                    if s <= top:
                        continue
                    if bpe:
                        p = last[end - n]
                        if not (apart(p, k) if p >= 0 else p != -3 and single(k)):
                            continue
                    top, piece, start = s, k, end - n
                    if bpe:  # merging leaves one path
                        break
                if word[end - 1] not in ids and (not bpe or piece == -3):
                    s = best[end - 1] + self.low
                    if s > top:
                        top, piece, start = s, -2, end - 1
                best.append(top)
                last.append(piece)
                back.append(start)
            before = word
            at, path = len(word), []
            while at:
                path.append(self._fallback(word[at - 1])[::-1] if last[at] == -2 else (last[at],))
                at = back[at]
            self.cache[word] = np.array([i for p in path for i in p][::-1], dtype=np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. A literal mark is escaped, so that decoding tells it from a space, and so is the escape itself."""
        split, runs = self.split.findall, []
        for t in texts:
            if not t:
                runs.append([])
                continue
            if MARK in t or ESCAPE in t:
                t = t.replace(ESCAPE, ESCAPE + "0").replace(MARK, ESCAPE + "1")
            runs.append(split(MARK + t.replace(" ", MARK)))
        if len(self.cache) > CACHE // 2:  # words in use move on, the others go with the next change
            self.old, self.cache = self.cache, {}
        fresh = set().union(*runs) - self.cache.keys()
        for w in fresh & self.old.keys():
            self.cache[w] = self.old[w]
        self.words(fresh - self.cache.keys())
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, r)), dtype=np.int32) for r in runs]

    def decode(self, ids: np.ndarray) -> str:
        """The text: bytes of its pieces without the first mark."""
        out = b"".join(map(self.out.__getitem__, ids.tolist()))
        text = (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")
        return text.replace(ESCAPE + "1", MARK).replace(ESCAPE + "0", ESCAPE) if ESCAPE in text else text


def _texts(column: pa.Array) -> list[str | None]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token_ids for every row, null and repeated ids included. A null or empty text has no ids; any other text starts with
    a mark. Bytes that aren't UTF-8 are read as U+FFFD. Other columns aren't read. A task holds the longest text some ten times over."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for part in pieces(batch, "text", CHUNK):
                ids = codec.encode([t or "" for t in _texts(part.column("text"))])
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "token_ids"])

    frame = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), column_or_null(docs, text_col, "string").alias("text"))
    return frame.mapInArrow(run, "doc_id long, token_ids array<int>")


def decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of frames with doc_id and token_ids; null ids give an empty text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [codec.decode(np.array(x.as_py() or [], dtype=np.int32)) for x in part.column("token_ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lists, type=pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def encode_and_check(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, tokens_sha256 (of the ids as little-endian int32), round_trip (decoding gives the text again) for every row;
    see encode for null texts and others. keep_ids adds token_ids."""
    path = model or default_model()
    names = ["doc_id", "n_tokens", "tokens_sha256", "round_trip", *(["token_ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for part in pieces(batch, "text", CHUNK):
                texts = [t or "" for t in _texts(part.column("text"))]
                ids = codec.encode(texts)
                columns = [
                    part.column("doc_id"), pa.array([len(i) for i in ids], type=pa.int64()), pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids]),
                    pa.array([codec.decode(i) == t for i, t in zip(ids, texts, strict=True)]),
                ]
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    frame = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), column_or_null(docs, text_col, "string").alias("text"))
    return frame.mapInArrow(run, "doc_id long, n_tokens long, tokens_sha256 string, round_trip boolean" + (", token_ids array<int>" if keep_ids else ""))
