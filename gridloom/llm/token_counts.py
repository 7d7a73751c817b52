"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

A word (a match of the pre-tokenizer, as byte symbols of which the last carries the end-of-word mark) is read symbol by
symbol. BPE has the property that a token sequence is the word's encoding if and only if each neighbouring pair of tokens
is the encoding of the two joined, so for every prefix the last token is the only one that ends there and agrees with the
last token of what is before it. The transducer's state is therefore the set of vocabulary paths that are open, each with
the last token before it and the count there relative to here; reading a symbol gives the next state and the change of
the token count, which annotates the transition. States and transitions are made when first met and then kept.

Texts are read in chunks. A chunk's state map is kept in the form (head, count, tail): whole words inside give a count for
any entry state; head and tail are the symbols that have to be run from the neighbour's exit state. Such maps compose
associatively, so chunks can be counted on their own and be joined by a prefix scan.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows without or with repeated doc_id each get their row;
an empty table gives an empty table. Columns besides the two named ones are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import tune

#: Code points of one chunk.
CHUNK = 65_536
#: Words and states that a worker keeps; beyond it they are forgotten and made again.
MAX_WORDS, MAX_STATES = 400_000, 200_000
#: Of words: the longest that is kept, and characters of all.
MAX_WORD_CHARS, MAX_HELD_CHARS = 512, 16 << 20


@cache
def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return [out[b] for b in range(256)]


@cache
def newer() -> re.Pattern:
    """Code points that Python's Unicode tables may not know: those without a category, and all beyond the first plane."""
    unknown = [c for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn"]
    ranges, start = [], 0
    for k, c in enumerate(unknown):
        if k + 1 == len(unknown) or unknown[k + 1] != c + 1:
            ranges.append(f"\\u{unknown[start]:04x}-\\u{c:04x}")
            start = k + 1
    return re.compile(f"[{''.join(ranges)}\\U00010000-\\U0010ffff]")  # one table and one range: as fast for any number of them


class Transducer:
    """Counts the BPE tokens of a word. end is the mark of a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = ""):
        self.vocab, self.end = vocab, end
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(merges)}
        self.split = {}  # a token's symbols, by what the merges make it of
        self.agree_memo: dict[tuple[str, str], bool] = {}
        self.trie: list[dict] = [{}]
        self.token_at: list[str | None] = [None]
        for t in vocab:
            s = self._symbols_of_token(t)
            if s and self._merge(s) == [t]:
                self._add(s, t)
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {((0, "", 0),): 0}
        self.paths: list[tuple] = [((0, "", 0),)]
        self.moves: list[dict] = [{}]

    def _symbols_of_token(self, t: str) -> list[str]:
        e = self.end
        if e and t.endswith(e) and len(t) > len(e):
            body = t[: -len(e)]
            return [*body[:-1], body[-1] + e]
        return list(t)

    def _merge(self, s: list[str]) -> list[str]:
        s = list(s)
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda i: self.rank.get((s[i], s[i + 1]), 1 << 60))
            pair = (s[best], s[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == pair[0] and s[i + 1] == pair[1]:
                    out.append(s[i] + s[i + 1])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            s = out
        return s

    def _add(self, symbols: list[str], token: str) -> None:
        at = 0
        for x in symbols:
            to = self.trie[at].get(x)
            if to is None:
                to = self.trie[at][x] = len(self.trie)
                self.trie.append({})
                self.token_at.append(None)
            at = to
        self.token_at[at] = token

    def agree(self, a: str, b: str) -> bool:
        """Whether b can follow a: the two joined are encoded as a, b."""
        if not a:
            return True
        known = self.agree_memo.get((a, b))
        if known is None:
            if len(self.agree_memo) > 1_000_000:
                self.agree_memo.clear()
            known = self.agree_memo[a, b] = self._merge(self._symbols_of_token(a) + self._symbols_of_token(b)) == [a, b]
        return known

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        """The transition by symbol: (next state, change of the count at this prefix)."""
        opened, last, count = [], None, 0
        for node, before, rel in self.paths[state]:
            to = self.trie[node].get(symbol)
            if to is None:
                continue
            token = self.token_at[to]
            if token is not None and last is None and self.agree(before, token):
                last, count = token, rel + 1
            if self.trie[to]:
                opened.append((to, before, rel))
        if last is None:
            raise ValueError(f"no token ends at {symbol!r}: the vocabulary lacks a symbol")
        path = tuple((n, b, r - count) for n, b, r in opened) + ((0, last, 0),)
        to = self.states.get(path)
        if to is None:
            to = self.states[path] = len(self.paths)
            self.paths.append(path)
            self.moves.append({})
        self.moves[state][symbol] = to, count
        return to, count

    def count(self, symbols: list[str]) -> int:
        """Tokens of one word."""
        if len(self.paths) > MAX_STATES:
            self.reset()
        state, total, moves = 0, 0, self.moves
        for x in symbols:
            move = moves[state].get(x) or self._compile(state, x)
            state = move[0]
            total += move[1]
        return total


class Counter:
    """Token counts of whole texts for a tokenizers file: BPE over byte symbols with an end-of-word mark, white space dropped, lower case."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.machine = Transducer(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.end = self.machine.end
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.byte = byte_symbols()
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.words: dict[str, int] = {}
        self.held = 0  # characters of these

    def _matches(self, piece: str) -> int:
        n = 0
        for m in self.pattern.findall(piece):
            s = [self.byte[b] for b in m.encode()]
            s[-1] += self.end
            n += self.machine.count(s)
        return n

    def _normal(self, text: str) -> str:
        """Lower case in composed form; by the library itself where a text holds letters newer than Python's Unicode tables."""
        if not text.isascii():
            if newer().search(text):
                return self.normalizer.normalize_str(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def piece(self, run: str) -> int:
        """Tokens of a run without white space; matches never cross white space."""
        n = self.words.get(run)
        if n is None:
            n = self._matches(run)
            if len(run) <= MAX_WORD_CHARS:  # text without white space is a run as long as itself
                if len(self.words) > MAX_WORDS or self.held > MAX_HELD_CHARS:
                    self.words.clear()
                    self.held = 0
                self.words[run] = n
                self.held += len(run)
        return n

    def chunk_map(self, text: str) -> tuple[str, int | None, str]:
        """(head, count, tail) of a chunk; count is None if no white space is in it, then all is head."""
        first = regex.search(r"\s", text)
        if first is None:
            return text, None, ""
        head = text[: first.start()]
        tail = regex.search(r"\S*\Z", text[first.start() :])[0]
        body = text[first.start() : len(text) - len(tail)]
        return head, sum(map(self.piece, self._runs(body))), tail

    @staticmethod
    def _runs(text: str) -> list[str]:
        if regex.search("[\x1c-\x1f]", text):  # str.split() takes these for white space; the pattern doesn't
            return regex.findall(r"\S+", text)
        return text.split()

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two chunks one after the other; associative."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        between = a[2] + b[0]
        return a[0], a[1] + b[1] + (self.piece(between) if between else 0), b[2]

    def close(self, m: tuple) -> int:
        return sum(self.piece(x) for x in (m[0], m[2]) if x) + (m[1] or 0)

    def part(self, text: str) -> int:
        """Tokens of a text without special strings."""
        text = self._normal(text)
        if len(text) <= CHUNK:
            return sum(map(self.piece, self._runs(text)))
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # pairwise, as a parallel scan would
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.close(maps[0])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" not in text:
            return self.part(text)
        cut = self.special.findall(text)
        return len(cut) + sum(self.part(x) for x in self.special.split(text) if x)


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit). vocabulary names a file that every executor has installed."""

    def run(batches):
        c = counter(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [c.count(t) for t in texts]
            yield pa.record_batch([b.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
