"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that ends the prefix's encoding. A pass of
an Aho-Corasick automaton over the word lists, for each end, every vocabulary token that is a suffix
there; the one that is compatible with the last token of the prefix before it is stored. Following
the stored tokens back from the end gives the ids. No merge loop runs.

Two tokens are compatible when the merge procedure, run over their joint symbols, never crosses
the border between them. That is decided on the merge trees: along the right spine of the left
token and the left spine of the right token, the pair that faces each other across the border must
not merge earlier than either of its sides is absorbed by its own parent.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import text_column

#: Words kept in a worker's memory; the store is emptied when it is full.
WORDS_KEPT = 400_000
PAIRS_KEPT = 2_000_000
#: A word's last symbol is moved up by this, so that it differs from the same symbol elsewhere.
FINAL = 0x10000
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, all other bytes take the characters from 256 on, in order."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in itself else chr(next(spare)) for b in range(256)]


class Codec:
    """An encoder and decoder made from the text of a tokenizer file.

    Understands byte-level BPE files whose normaliser is NFC, white space, lower case, whose words
    come from a split pattern, and whose vocabulary may mark the ends of words."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        doc = json.loads(spec)
        model = doc["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in doc.get("added_tokens", ())}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}
        self.special = {t: i for t, i in added.items()}
        self._special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        steps = (doc.get("normalizer") or {}).get("normalizers", [])
        self._nfc = any(s["type"] == "NFC" for s in steps)
        self._lower = any(s["type"] == "Lowercase" for s in steps)
        pattern = next(p["pattern"]["Regex"] for p in doc["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(pattern, regex.V0).findall
        self._rare = regex.compile("[^\x00-\u0557\u2000-\u208e]").search
        self._spec, self._library = spec, None
        self._bytes = {b: s for b, s in enumerate(byte_symbols())}

        def symbols(t: str) -> str:
            if self.suffix and t.endswith(self.suffix):
                t = t[: -len(self.suffix)]
                return t[:-1] + chr(ord(t[-1]) + FINAL)
            return t

        self._rank: dict[tuple[int, int], int] = {}
        self._up: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            made = vocab.get(a + b)
            if made is None or a not in vocab or b not in vocab:
                continue
            pair = (vocab[a], vocab[b])
            self._rank.setdefault(pair, r)
            if made not in parts:
                parts[made] = pair
                self._up[made] = r
        # spines: from a token's outermost symbol up to the token, each with the rank of the merge that absorbs it
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        whole: dict[int, bool] = {}
        by_rank = sorted(vocab.values(), key=lambda i: self._up.get(i, -1))
        for i in by_rank:
            if i not in parts:
                self._right[i] = self._left[i] = [(i, _NEVER)]
                whole[i] = True
                continue
            x, y = parts[i]
            r = self._up[i]
            self._right[i] = [*self._right[y][:-1], (y, r), (i, _NEVER)]
            self._left[i] = [*self._left[x][:-1], (x, r), (i, _NEVER)]
            whole[i] = whole[x] and whole[y] and self._border(self._right[x], self._left[y], top=(x, y))
        self._length: dict[int, int] = {}
        self._find = ahocorasick.Automaton()
        for t, i in vocab.items():
            s = symbols(t)
            # single symbols are always whole; longer entries only if the merges lead to them
            if whole[i] and (i in parts or len(s) == 1):
                self._length[i] = len(s)
                self._find.add_word(s, i)
        self._find.make_automaton()
        self._known: dict[str, list[int]] = {}

    def _border(self, left: list[tuple[int, int]], right: list[tuple[int, int]], top: tuple[int, int] | None = None) -> bool:
        """Whether no merge crosses the border. With top, the pair top itself may merge at the end."""
        i = j = 0
        while True:
            (a, ra), (b, rb) = left[i], right[j]
            m = self._rank.get((a, b), _NEVER)
            if m < ra and m <= rb:  # of equal ranks the left place merges first
                return (a, b) == top
            if ra == rb == _NEVER:
                return True
            if ra <= rb:
                i += 1
            else:
                j += 1

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= PAIRS_KEPT:
                self._fits.clear()
            known = self._fits[key] = self._border(self._right[left], self._left[right])
        return known

    def _word(self, word: str) -> list[int]:
        return self._symbols(word.encode("utf-8").decode("latin-1").translate(self._bytes))

    def _symbols(self, s: str) -> list[int]:
        if self.suffix:
            s = s[:-1] + chr(ord(s[-1]) + FINAL)
        last: list[int] = [-1] * (len(s) + 1)
        length, fits = self._length, self.fits
        for end, t in self._find.iter(s):
            end += 1
            if last[end] < 0:
                start = end - length[t]
                if start == 0 or (last[start] >= 0 and fits(last[start], t)):
                    last[end] = t
        ids, at = [], len(s)
        while at:
            t = last[at]
            if t < 0:
                raise ValueError(f"no encoding of {s[:50]!r}")
            ids.append(t)
            at -= length[t]
        ids.reverse()
        return ids

    def _by_library(self, text: str, ids: list[int]) -> None:
        """For texts with characters on whose class or case releases of Unicode may differ: the
        words come from the library's own normaliser and splitter, the ids from here."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._spec)
        if self._library.normalizer is not None:
            text = self._library.normalizer.normalize_str(text)
        for s, _ in self._library.pre_tokenizer.pre_tokenize_str(text):
            ids.extend(self._symbols(s))

    def _plain(self, text: str, ids: list[int]) -> None:
        if self._rare(text):
            return self._by_library(text, ids)
        if self._nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self._lower:
            # character by character, as the library does it: a final sigma is no exception
            text = text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()
        known, add = self._known, ids.extend
        for w in self._words(text):
            got = known.get(w)
            if got is None:
                if len(known) >= WORDS_KEPT:
                    known.clear()
                got = self._word(w)
                if len(w) < 64:
                    known[w] = got
            add(got)

    def encode(self, text: str) -> list[int]:
        """The ids of a text; the strings of special tokens in it become their ids."""
        ids: list[int] = []
        if self._special_split is None or "<|" not in text and not any(t in text for t in self.special):
            self._plain(text, ids)
            return ids
        for k, part in enumerate(self._special_split.split(text)):
            if k % 2:
                ids.append(self.special[part])
            elif part:
                self._plain(part, ids)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens, joined by spaces: what the library gives for files without a decoder."""
        return " ".join([self.token[i] for i in ids])


_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """One codec for each file in a worker's life."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


KINDS = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_SQL = {"ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def transcode(df: DataFrame, tokenizer: str, outputs: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, and decode what was encoded, one row in for one row out.

    tokenizer: path of a tokenizer file; it is read here and sent along (1 to 2 MB, whatever the
    data). outputs: of ids, decoded, n_tokens, ids_sha256 (of the decimal ids joined by a space) and
    decoded_sha256. Null and empty texts have no ids and decode to the empty string. Repeated rows
    stay repeated; other columns of df are ignored. A narrow map: no shuffle, any row can be redone."""
    spec = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        decimal = {i: str(i) for i in c.token}
        for batch in batches:
            out: dict[str, list] = {o: [] for o in outputs}
            for text in batch.column(1):
                ids = c.encode(text.as_py())
                decoded = c.decode(ids) if "decoded" in out or "decoded_sha256" in out else ""
                for o, rows in out.items():
                    if o == "ids":
                        rows.append(ids)
                    elif o == "decoded":
                        rows.append(decoded)
                    elif o == "n_tokens":
                        rows.append(len(ids))
                    elif o == "ids_sha256":
                        rows.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                    else:
                        rows.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, KINDS[o]) for o, v in out.items()]], ["doc_id", *out])

    return text_column(df, id_col, text_col).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{o} {_SQL[o]}" for o in outputs))
