"""Exact token counts at every prefix of a text, and token ids of whole texts.

The vocabulary splits a text into words first and encodes each word alone, so
the count at a prefix satisfies ``count(i) = count(start of the word that holds
i) + tokens(that word up to i)``. ``PrefixTable`` has the counts at all word
starts from one pass over the text; inside a word the counts follow by dynamic
programming over its characters: a prefix ends in exactly one token that may
stand after the last token of the prefix before it. Budget and truncation
questions are look-ups; nothing is encoded for them.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import in_batches, table, text_or_empty

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Distinct words kept by a worker; beyond it the store starts anew.
KEPT_WORDS = 400_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain_classes() -> tuple[str, str, str]:
    """Characters that the fast way reads as the library does: all of them, letters, numbers.

    Printable ASCII, tab, line ends and the composed Latin letters and signs up
    to U+017F; any other character sends its text to the library itself.
    """
    odd = {0xAD, 0x130, 0x149}
    chars = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x180)) if c not in odd]
    pick = lambda kind: "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == kind)
    return "\t\n\r" + "".join(map(re.escape, chars)), pick("L"), pick("N")


_ALL, _LETTERS, _NUMBERS = _plain_classes()
PLAIN = re.compile(f"[{_ALL}]*")
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


#: A word's end in the vocabulary's tokens, and how the vocabulary splits any normalised text (fixed values of the vocabulary).
WORD_END = "</w>"
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SYMBOLS = regex.compile(r"[^\p{White_Space}\p{L}\p{N}]+")
BLANKS_AT_END = regex.compile(r"\p{White_Space}*$")
CHUNKS = regex.compile(r"\P{White_Space}+")


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it has one, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


_BYTE = _byte_characters()


def _normal(text: str) -> str:
    """The text as the vocabulary reads it; letters are lower-cased one by one."""
    return "".join([c.lower() for c in unicodedata.normalize("NFC", text)])


class PrefixCounts:
    """Token counts of all prefixes of a word by dynamic programming."""

    def __init__(self, model: dict):
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): k for k, m in enumerate(model["merges"])}
        self.vocabulary = model["vocab"]
        self.longest = max(len(t.removesuffix(WORD_END)) for t in self.vocabulary)
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[str, list[int]] = {}

    def _merged(self, symbols: list[str]) -> list[str]:
        """A few symbols merged as far as they go, the earliest merge of the vocabulary first."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda k: self.rank.get((symbols[k], symbols[k + 1]), len(self.rank)))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.rank:
                break
            out, k = [], 0
            while k < len(symbols):
                both = tuple(symbols[k : k + 2]) == pair
                out.append(symbols[k] + symbols[k + 1] if both else symbols[k])
                k += 2 if both else 1
            symbols = out
        return symbols

    def _follows(self, left: str, right: str) -> bool:
        """Whether ``right`` is the token that comes after ``left``, the last one before it ("" at a word's begin)."""
        if (left, right) not in self.fits:
            if len(self.fits) > KEPT_WORDS:
                self.fits.clear()
            body = right.removesuffix(WORD_END)
            symbols = [*left, *body[:-1], body[-1] + right[len(body) :]]
            self.fits[left, right] = self._merged(symbols) == ([left, right] if left else [right])
        return self.fits[left, right]

    def of(self, word: str) -> list[int]:
        """Tokens of the first 0, 1, 2, ... byte characters of ``word``, each as a whole word."""
        if word not in self.known:
            if len(self.known) > KEPT_WORDS:
                self.known.clear()
            last, inner, whole = [""], [0], [0]
            for end in range(1, len(word) + 1):
                for kept, tail in ((inner, ""), (whole, WORD_END)):
                    for size in range(min(self.longest, end), 0, -1):
                        token = word[end - size : end] + tail
                        if token in self.vocabulary and self._follows(last[end - size], token):
                            kept.append(inner[end - size] + 1)
                            if not tail:
                                last.append(token)
                            break
            self.known[word] = whole
        return self.known[word]

    def count(self, text: str, specials: tuple[str, ...]) -> int:
        """Tokens of a short text of any kind."""
        total = 0
        for part in re.split(f"({'|'.join(map(re.escape, specials))})", text) if specials else [text]:
            if part in specials:
                total += 1
            else:
                total += sum(self.of(_bytes(w))[-1] for w in PRE_TOKENS.findall(_normal(part)))
        return total

    def inside(self, word: str, specials: tuple[str, ...]) -> list[int]:
        """Tokens of the first 0, 1, 2, ... characters of a piece of text that a word begins with."""
        alone = [_normal(c) for c in word]
        joined = "".join(alone)
        if _normal(word) == joined and PRE_TOKENS.fullmatch(joined) and not any(x in word for x in specials) and not joined.startswith("'"):
            counts = self.of(_bytes(joined))
            return [counts[k] for k in accumulate((len(c.encode()) for c in alone), initial=0)]
        return [self.count(word[:k], specials) for k in range(len(word) + 1)]


def _bytes(word: str) -> str:
    return "".join([_BYTE[b] for b in word.encode()])


class TokenTable:
    """Token ids and prefix counts of texts, equal to the library's."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path = path or vocabulary_path()
        self.library = Tokenizer.from_file(self.path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.ids: dict[str, bytes] = {}
        self._counts: PrefixCounts | None = None

    @property
    def counts(self) -> PrefixCounts:
        """Made when a prefix inside a word is first asked for."""
        if self._counts is None:
            with open(self.path, encoding="utf-8") as f:
                self._counts = PrefixCounts(json.load(f)["model"])
        return self._counts

    def _words(self, text: str) -> list[str] | None:
        """The words as the vocabulary splits them, all of them in ``ids``; None for a text that the library has to read."""
        if "<|" in text or not PLAIN.fullmatch(text):
            return None
        words = WORDS.findall(text.lower())
        known = self.ids
        if new := {w for w in words if w not in known}:
            if len(known) > KEPT_WORDS:
                known.clear()
                new = set(words)
            self._learn(list(new))
        return words

    def _learn(self, words: list[str]) -> None:
        """Encode words side by side; a blank ends a word, so each is encoded as if alone."""
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            e = self.library.encode(" ".join(part), add_special_tokens=False)
            ids = np.asarray(e.ids, dtype="<u4").tobytes()
            of = np.asarray(e.word_ids, dtype=np.int64)
            ends = np.searchsorted(of, np.arange(len(part) + 1))
            for k, w in enumerate(part):
                self.ids[w] = ids[4 * ends[k] : 4 * ends[k + 1]]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if (words := self._words(text)) is None:
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.ids.__getitem__, words))

    def table(self, text: str) -> "PrefixTable":
        return PrefixTable(self, text)


class PrefixTable:
    """Token counts at every prefix of one text of any script, from one pass over it.

    The text is a row of units, most of them words; ``totals`` has the count
    before each unit and after the last.
    """

    def __init__(self, tokens: TokenTable, text: str):
        self.tokens, self.text = tokens, text
        words = tokens._words(text)
        if words is not None:
            known = tokens.ids
            self._starts: list[int] | None = None
            self.totals = np.cumsum([0, *[len(known[w]) for w in words]]) // 4
        else:
            self._starts, self.totals = self._read()

    def _read(self) -> tuple[list[int], np.ndarray]:
        """Starts of units and totals from one encoding by the library.

        Where characters compose with their neighbours, all that stands between
        white space is one unit; signs before a special string join its unit.
        """
        e = self.tokens.library.encode(self.text, add_special_tokens=False)
        first: dict[int, list[int]] = {}
        for w, (a, b) in zip(e.word_ids, e.offsets, strict=True):
            at = first.setdefault(w, [a, b, 0])
            at[0], at[1], at[2] = min(at[0], a), max(at[1], b), at[2] + 1
        spans = sorted(first.values())
        loose = [m.span() for m in CHUNKS.finditer(self.text) if not unicodedata.is_normalized("NFC", m[0])]
        begins = [a for a, _ in loose]
        starts, totals, before = [], [0], None
        for a, b, n in spans:
            k = bisect_right(begins, a) - 1
            chunk = loose[k] if k >= 0 and a < loose[k][1] else None
            special = self.text[a:b] in self.tokens.specials
            joins = before is not None and (a < before[1] or (chunk is not None and before[2] == chunk) or (special and before[1] == a and SYMBOLS.fullmatch(self.text[before[0] : before[1]])))
            if joins:
                totals[-1] += n
            else:
                starts.append(chunk[0] if chunk else a)
                totals.append(totals[-1] + n)
            before = (starts[-1], b, chunk)
        return starts, np.asarray(totals)

    def __len__(self) -> int:
        return len(self.text)

    @property
    def starts(self) -> list[int]:
        if self._starts is None:
            self._starts = [m.start() for m in WORDS.finditer(self.text.lower())]
        return self._starts

    @property
    def total(self) -> int:
        return int(self.totals[-1])

    def _inside(self, k: int) -> list[int]:
        """Counts inside the k-th unit and the white space after it, from its start on."""
        end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
        unit = self.text[self.starts[k] : end]
        word = unit[: BLANKS_AT_END.search(unit).start()]
        inside = self.tokens.counts.inside(word, self.tokens.specials)
        return inside + [inside[-1]] * (len(unit) - len(word))

    def at(self, i: int) -> int:
        """Tokens of ``text[:i]``."""
        i = max(0, min(i, len(self.text)))
        k = bisect_right(self.starts, i - 1) - 1
        return int(self.totals[k]) + self._inside(k)[i - self.starts[k]] if k >= 0 else 0

    def counts(self) -> np.ndarray:
        """The whole table: tokens of ``text[:0]``, ``text[:1]``, ..."""
        out = np.zeros(len(self.text) + 1, np.int64)
        for k, s in enumerate(self.starts):
            inside = self._inside(k)
            out[s : s + len(inside)] = self.totals[k] + np.asarray(inside)
        return out

    def cut(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.text)
        k = int(np.searchsorted(self.totals, budget, side="right")) - 1  # the unit that goes over
        return self.starts[k] + max(j for j, n in enumerate(self._inside(k)) if self.totals[k] + n <= budget)


_TABLES: dict[str, TokenTable] = {}


def worker_table(path: str) -> TokenTable:
    """One table for each Python worker and vocabulary."""
    if path not in _TABLES:
        _TABLES[path] = TokenTable(path)
    return _TABLES[path]


def token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of every row.

    ``n_tokens`` is the last entry of the prefix table; ``fit_chars`` the code
    points of the longest prefix within ``limit`` tokens. A null text counts as
    empty: 0 bytes, 0 tokens. Texts of any length and script have a table of
    their own. Repeated rows stay repeated, ids may be null, other columns are
    ignored, an empty table gives an empty result.
    """
    path = vocabulary or vocabulary_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_table(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            tables = [tokens.table(t) for t in b.column("text").to_pylist()]
            counts = [t.total for t in tables]
            fit = [t.cut(limit) for t in tables]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(fit, pa.int64()), b.column("n_bytes")],
                ["doc_id", "n_tokens", "fit_chars", "n_bytes"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = in_batches(rows, work, f"doc_id {kind}, n_tokens long, fit_chars long, n_bytes long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def token_pieces(docs: DataFrame, capacity: int = LIMIT, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and ``end_id``, cut at ``capacity``.

    A null or empty text is the end id alone. Rows that repeat a document give
    its pieces again; ids may be null; other columns are ignored; an empty
    table gives an empty result.
    """
    path = vocabulary or vocabulary_path()
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_table(path)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                ids = tokens.encode(t) + end
                n = len(ids) // 4
                for j, s in enumerate(range(0, n, capacity)):
                    e = min(n, s + capacity)
                    row.append(k)
                    piece.append(j)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[4 * s : 4 * e]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_batches(rows, work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of every document; rules for odd rows as in ``token_counts``."""
    return token_counts(table(spark, sf_dir, "documents"))
