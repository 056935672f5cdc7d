"""Token counts at every prefix of a text by prefix dynamic programming."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.common import BoundedCache, TextCache, in_pieces, text_of
from citeloom.llm.packing import byte_alphabet

#: A run of the common form: white space on which all engines agree, Latin letters that neither compose nor grow in lower
#: case, then marks other than those of contractions and added tokens.
COMMON = re.compile(r"([A-Za-zÀ-ÖØ-öø-įĲ-ƿǍ-Ȳ]*)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)").fullmatch
CUT = re.compile(r"[ \t\n\r]+|[^ \t\n\r]+").findall
TAIL = 8  # characters of an open pre-token that tell whether what follows joins it


class Merges:
    """Byte-pair merges with word ends, as read from the tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)): i for i, m in enumerate(model["merges"])}
        self.made: dict[str, list[tuple[str, str]]] = {}
        for pair in self.rank:
            self.made.setdefault(pair[0] + pair[1].removesuffix(self.end) + self.end * pair[1].endswith(self.end), []).append(pair)
        self.names = sorted(model["vocab"])
        self.inside, self.ending = ahocorasick.Automaton(), ahocorasick.Automaton()
        for number, token in enumerate(self.names):
            closed = bool(self.end) and token.endswith(self.end)
            text = token.removesuffix(self.end) if closed else token
            if closed or not self.end:
                self.ending.add_word(text, (len(text), number))
            if not closed:
                self.inside.add_word(text, (len(text), number))
        self.inside.make_automaton()
        self.ending.make_automaton()
        self.longest = max(map(len, self.names))
        self.pairs = BoundedCache(lambda key: self._stand(self.names[key >> 20], self.names[key & 0xFFFFF]), 1_000_000)
        self.whole = BoundedCache(lambda number: len(self._merge(self.names[number])) == 1, 200_000)
        self.edges = BoundedCache(self._edges, 200_000)

    def _merge(self, token: str) -> list[str]:
        """Tokens of a string, by applying the lowest merge again and again."""
        closed = bool(self.end) and token.endswith(self.end)
        parts = list(token.removesuffix(self.end) if closed else token)
        if closed:
            parts[-1] += self.end
        while len(parts) > 1:
            rank, i = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == len(self.rank):
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edges(self, token: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
        """How the first and the last symbol of a token grow into it: (symbol, rank of the merge that makes it), in order."""
        ways = self.made.get(token, [])
        if not ways:
            return [(token, -1)], [(token, -1)]
        left, right = min(ways, key=self.rank.__getitem__)
        rank = self.rank[left, right]
        return self.edges[left][0] + [(token, rank)], self.edges[right][1] + [(token, rank)]

    def _stand(self, before: str, after: str) -> bool:
        """Whether two tokens stay apart: no merge across their border comes before one of its sides has grown on."""
        left, right = self.edges[before][1], self.edges[after][0]
        i = j = 0
        never = len(self.rank) + 1
        while True:
            grow_left = left[i + 1][1] if i + 1 < len(left) else never
            grow_right = right[j + 1][1] if j + 1 < len(right) else never
            across = self.rank.get((left[i][0], right[j][0]), never)
            if across < grow_left and across <= grow_right and across != never:
                return False
            if grow_left == never and grow_right == never:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of word[:k] taken as a whole word, for k = 1..len(word).

        The last token of an encoding is the one token that ends there and stands the pair test with the last token of
        what precedes it, and what precedes it is encoded as it would be alone. So two tables over the prefixes are
        enough: one for prefixes inside a word, one for prefixes that end the word.
        """
        pairs, whole = self.pairs, self.whole
        last, count, closed = [0] * (len(word) + 1), [0] * (len(word) + 1), [0] * len(word)
        for table, ends in ((self.inside, False), (self.ending, True)):
            found = -1
            for at, (size, token) in table.iter(word):
                if at == found:
                    continue
                i = at + 1 - size
                if (i == 0 or pairs[last[i] << 20 | token]) and whole[token]:
                    found = at
                    if ends:
                        closed[at] = count[i] + 1
                    else:
                        last[at + 1], count[at + 1] = token, count[i] + 1
        return closed


class _Growing:
    """A pre-token that grows: its prefix tables go on from where they were, so a step costs as much as it adds."""

    def __init__(self, merges: Merges):
        self.merges, self.word, self.last, self.count = merges, "", [0], [0]

    def _step(self, more: str) -> tuple[list[int], list[int], int]:
        """Last tokens and counts at the places of ``more``, and the tokens if the pre-token ended after it."""
        merges, known = self.merges, len(self.word)
        tail = self.word[-merges.longest:]
        base = known - len(tail)
        last, count = self.last[base:] + [0] * len(more), self.count[base:] + [0] * len(more)
        closed = 0
        for table, ends in ((merges.inside, False), (merges.ending, True)):
            found = -1
            for at, (size, token) in table.iter(tail + more):
                if at < len(tail) or at == found or (ends and at + 1 < len(tail) + len(more)):
                    continue
                i = at + 1 - size
                if (base + i == 0 or merges.pairs[last[i] << 20 | token]) and merges.whole[token]:
                    found = at
                    if ends:
                        closed = count[i] + 1
                    else:
                        last[at + 1], count[at + 1] = token, count[i] + 1
        return last[len(tail) + 1:], count[len(tail) + 1:], closed

    def closed(self, more: str) -> int:
        return self._step(more)[2]

    def push(self, more: str) -> None:
        last, count, _ = self._step(more)
        self.last += last
        self.count += count
        self.word += more


class PrefixCounter:
    """Exact token counts of every prefix of a text, in code points of the text as given."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.find_special = regex.compile("|".join(map(regex.escape, self.special))).search if self.special else lambda _: None
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        self.words = TextCache(self.merges.prefix_counts, 12 << 20)
        self.steps = TextCache(self._word, 48 << 20)
        self.deltas = TextCache(self._deltas, 96 << 20)

    def _pieces(self, text: str) -> list[str]:
        """Pre-tokens in the byte alphabet of the vocabulary."""
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def _count(self, text: str) -> int:
        return sum(self.words[p][-1] for p in self._pieces(text) if p)

    def _plain(self, text: str) -> list[int]:
        """Counts after each code point of a run without white space and without added tokens."""
        composes = any(end - start > 1 and not unicodedata.is_normalized("NFC", text[start:end]) for start, end in self._stable(text))
        return self._grown(text) if composes else self._scan(text)

    def _grown(self, text: str) -> list[int]:
        """Counts after each code point of a run that composes, or grows in lower case. A stretch is normalised by itself; what
        stands before it is kept as finished pre-tokens and an open one, and only the open one may change."""
        out: list[int] = []
        done, tail, open_ = 0, "", _Growing(self.merges)
        for start, end in self._stable(text):
            for k in range(start + 1, end + 1):
                piece = self.library.normalizer.normalize_str(text[start:k])
                # a pre-token depends on few characters before its end, so a tail of the open one tells where it ends
                cuts = [(w, a, b) for w, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(tail + piece)]
                joined, rest = "", cuts
                if tail:
                    joined, rest = (tail + piece)[len(tail):cuts[0][2]], cuts[1:]
                grown = "".join(map(self.alphabet.__getitem__, joined.encode("utf-8")))
                known = open_.closed(grown) if tail and grown else self._ended(open_) if tail else 0
                out.append(done + known + sum(self.words[w][-1] for w, _, _ in rest if w))
            if tail:
                open_.push(grown)
            if rest:
                if tail:
                    done += self._ended(open_)
                done += sum(self.words[w][-1] for w, _, _ in rest[:-1] if w)
                open_ = _Growing(self.merges)
                open_.push(rest[-1][0])
                tail = ""
                last = (tail + piece)[-(rest[-1][2] - rest[-1][1]):]
                tail = last[-TAIL:]
            else:
                tail = (tail + joined)[-TAIL:]
        return out

    def _ended(self, open_: _Growing) -> int:
        """Tokens of the open pre-token as it is."""
        word = open_.word
        if len(word) <= 64:
            return self.words[word][-1]
        shorter = _Growing(self.merges)
        shorter.word, shorter.last, shorter.count = word[:-1], open_.last[:-1], open_.count[:-1]
        return shorter.closed(word[-1])

    @staticmethod
    def _stable(text: str) -> list[tuple[int, int]]:
        """Stretches that compose on their own: each begins at a character that never joins what precedes it."""
        if text.isascii():
            return [(i, i + 1) for i in range(len(text))]
        starts = [0] + [i for i in range(1, len(text)) if text[i].isascii() or (
            not unicodedata.combining(text[i]) and unicodedata.is_normalized("NFC", "a" + text[i])
            and not 0x1160 <= ord(text[i]) <= 0x11FF)]
        return list(zip(starts, [*starts[1:], len(text)]))

    def _scan(self, text: str) -> list[int]:
        """Counts after each code point of composed text: finished pre-tokens, then the cut one counted as if it ended."""
        out: list[int] = []
        done = 0
        parts = self._split(text)
        for part in parts:
            if part.isalpha():
                encoded = self.words[self._byte_word(part)]
                at = 0
                for ch in part:
                    at += len(ch.lower().encode("utf-8"))
                    out.append(done + encoded[at - 1])
            else:
                out.extend(done + self._count(part[:k]) for k in range(1, len(part) + 1)) if len(part) < 4 else out.extend(
                    self._run(part, done))
            done = out[-1] if out else 0
        return out

    def _run(self, part: str, done: int) -> list[int]:
        word = self._byte_word(part)
        if not word:  # white space that is not cut at, such as non-breaking spaces: no token
            return [done] * len(part)
        encoded = self.words[word]
        ends = np.cumsum([len(ch.lower().encode("utf-8")) for ch in part])
        return [done + encoded[e - 1] for e in ends]

    def _byte_word(self, part: str) -> str:
        return "".join(self._pieces(part))

    def _split(self, text: str) -> list[str]:
        """The pre-tokens as stretches of the text itself."""
        at, out = 0, []
        lowered = text if text.isascii() else None
        for _, (start, end) in self.library.pre_tokenizer.pre_tokenize_str(text.lower() if lowered is not None else
                                                                         "".join(map(_lower_one, text))):
            if start > at:
                out.append(text[at:start])
            out.append(text[start:end])
            at = end
        if at < len(text):
            out.append(text[at:])
        return out

    def _run_counts(self, chunk: str) -> list[int]:
        """Counts after each code point of a run without white space, added tokens included."""
        out: list[int] = []
        while chunk:
            found = self.find_special(chunk)
            plain = chunk[:found.start()] if found else chunk
            base = out[-1] if out else 0
            before = self._plain(plain) if plain else []
            out.extend(base + v for v in before)
            if not found:
                break
            # a cut inside the added token makes it ordinary text, which may join the marks before it
            marks = regex.search(r"[^\s\p{L}\p{N}]*$", plain).group()
            kept = base + (self._count(plain[:len(plain) - len(marks)]) if plain else 0)
            token = found.group()
            out.extend(kept + self._count(marks + token[:k]) for k in range(1, len(token)))
            out.append(base + (before[-1] if before else 0) + 1)
            chunk = chunk[found.end():]
        return out

    @staticmethod
    def _steps(counts: list[int]) -> bytes:
        return array("h", map(int.__sub__, counts, [0, *counts[:-1]])).tobytes()

    def _word(self, word: str) -> bytes:
        """Steps inside one pre-token: letters, or marks."""
        if word.isascii():
            return self._steps(self.words[word.lower()])
        low = word.lower()
        encoded, at, counts = self.words[self._byte_word(low)], -1, []
        for ch in low:
            at += len(ch.encode("utf-8"))
            counts.append(encoded[at])
        return self._steps(counts)

    def _deltas(self, chunk: str) -> bytes:
        """Steps of a run without a blank; it may hold other white space."""
        found = COMMON(chunk)
        if found:
            return b"".join([self.steps[p] for p in found.groups() if p])
        out = []
        for run in CUT(chunk):
            if run[0] in " \t\n\r":
                out.append(bytes(2 * len(run)))
            elif COMMON(run):
                out.append(self.deltas[run])
            elif not run.isascii() and any(len(ch.lower()) > 1 for ch in run) and not self.find_special(run):
                out.append(self._steps(self._grown(run)))
            else:
                out.append(self._steps(self._run_counts(run)))
        return b"".join(out)

    def deltas_of(self, text: str) -> bytes:
        """Changes of the count from one prefix to the next, as little-endian 16-bit numbers."""
        return b"\0\0".join(map(self.deltas.__getitem__, text.split(" ")))


def _lower_one(ch: str) -> str:
    low = ch.lower()
    return low if len(low) == 1 else ch


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The worker's counter for a tokenizer file; loaded once per process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 stored: bool = True) -> DataFrame:
    """Token counts of every prefix: ``doc_id, n_bytes, n_tokens, n_chars, prefix_deltas``.

    ``prefix_deltas`` holds, per code point, by how much the count of text[:k] differs from that of text[:k-1]
    (little-endian 16-bit); their running sum is the exact count at every prefix. ``stored=False`` leaves the column
    out when only the last sum is wanted.

    A text is cut at plain white space, which no token crosses. Each distinct run between is worked out once per worker
    by the dynamic program and kept in a bounded cache. No shuffle, a row in and a row out.

    Nulls: a null text is empty (0 bytes, 0 tokens), a null id is kept. Repeated rows give repeated rows. Texts may be
    of any length. An empty table gives an empty result. Columns other than the two named are not read.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    names = ["doc_id", "n_bytes", "n_tokens", "n_chars"] + ["prefix_deltas"] * stored

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(tokenizer)
        for batch in in_pieces(batches):
            texts = batch.column(1).to_pylist()
            deltas = [tool.deltas_of(t) for t in texts]
            columns = [batch.column(0), pa.compute.binary_length(batch.column(1)).cast(pa.int64()),
                       pa.array([int(np.frombuffer(d, "<i2").sum(dtype="int64")) for d in deltas], pa.int64()),
                       pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(deltas, pa.binary())] if stored else []), names=names)

    import pyarrow.compute  # noqa: F401  (used by the function above)

    return source.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, n_chars bigint" + ", prefix_deltas binary" * stored)


def _answer(prefixes: DataFrame, asked: str, out: str, work) -> DataFrame:
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("bigint")
    def answer(deltas, values):  # pandas series in and out
        import pandas as pd

        return pd.Series([None if d is None or pd.isna(v) else work(np.cumsum(np.frombuffer(d, "<i2"), dtype="int64"), int(v))
                          for d, v in zip(deltas, values)], dtype="Int64")

    return prefixes.withColumn(out, answer("prefix_deltas", F.col(asked)))


def tokens_at(prefixes: DataFrame, length_col: str, out: str = "tokens_at") -> DataFrame:
    """Tokens of text[:length], read from a stored prefix table; lengths outside the text mean its nearest end."""
    return _answer(prefixes, length_col, out, lambda sums, k: int(sums[min(k, len(sums)) - 1]) if k > 0 and len(sums) else 0)


def longest_within(prefixes: DataFrame, budget_col: str, out: str = "cut_at") -> DataFrame:
    """Length in code points of the longest prefix with at most ``budget`` tokens, from a stored prefix table."""
    def cut(sums: np.ndarray, budget: int) -> int:
        fits = np.flatnonzero(sums <= budget)
        return int(fits[-1]) + 1 if budget >= 0 and len(fits) else 0

    return _answer(prefixes, budget_col, out, cut)
