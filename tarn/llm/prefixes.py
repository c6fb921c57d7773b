"""Token counts of every prefix of a text, by dynamic programming over a vocabulary of merged pieces.

A sequence of pieces is what merging a text gives exactly if that holds for each two neighbours.
So the last token of a prefix is the one piece at its end that stands next to the last token of
what is before it, and the prefix has one token more than that: one pass from left to right over
the text finds the count of every prefix, without encoding any of them.

Counts are stored as their changes from one code point to the next, a byte each before they are
packed; truncation and budgets are answered from them alone.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.blocks import expand, gathered, squeeze
from tarn.llm.common import lean

SPACE = "▁"
#: Texts fall apart before each run of spaces, as no piece has a space after another character.
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Segments, and pairs of pieces, that a worker remembers. Beyond them all pairs are forgotten, and of
#: segments those that were not met since the last time.
SEGMENTS, PAIRS, SHORT = 1 << 18, 1 << 20, 64


class Vocabulary:
    """The pieces of a model of merged pieces with byte fallback, and counts of prefixes by them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = model.vocab_size()
        own = {model.id_to_piece(k): k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
        probe = " é ﬁ  A\t"
        fits = model.normalize(probe) == SPACE + probe.replace(" ", SPACE) and model.encode("\U000f0000") == [model.piece_to_id(x) for x in (SPACE, *(f"<0x{b:02X}>" for b in "\U000f0000".encode()))]
        if not fits or any(map(model.is_unused, own.values())) or any(SPACE in p.lstrip(SPACE) or not set(p) <= own.keys() for p in own):
            raise ValueError("a model of merged pieces with byte fallback, texts as they are and a space before them is needed")
        #: Of each piece its letters and its place among the scores, the best first, equals alike.
        self.letters = {k: [own[c] for c in p] for p, k in own.items()}
        place = {s: r for r, s in enumerate(sorted({model.get_score(k) for k in own.values()}, reverse=True))}
        #: What two pieces become, by first * size + second: (place of its score, piece).
        self.merges = {own[p[:i]] * size + own[p[i:]]: (place[model.get_score(k)], k) for p, k in own.items() for i in range(1, len(p)) if p[:i] in own and p[i:] in own}
        #: Pieces by their letters from the last to the first: {letter: [piece that starts with it or -1, the letters before]}.
        self.ends: dict = {}
        for p, k in own.items():
            node: list = [-1, self.ends]
            for c in reversed(p):
                node = node[1].setdefault(c, [-1, {}])
            node[0] = k
        self.pairs: dict[int, bool] = {}
        self.segments: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def follows(self, before: int, piece: int) -> bool:
        """Whether both pieces stay as they are if their letters are merged (before = size: nothing, or what never merges).

        Of all neighbours the pair of the best score is merged, the first of equals.
        """
        parts = [*self.letters.get(before, ()), *self.letters[piece]]
        border = len(parts) - len(self.letters[piece])
        while True:
            best, at = None, 0
            for k in range(len(parts) - 1):
                found = self.merges.get(parts[k] * self.size + parts[k + 1])
                if found and (best is None or found[0] < best[0]):
                    best, at = found, k
            if best is None:
                break
            if at == border - 1:
                return False
            border -= at < border
            parts[at : at + 2] = [best[1]]
        return parts == ([before, piece] if before < self.size else [piece])

    def _learn(self, segments: list[str]) -> None:
        """``segments`` into the known ones: for each code point by how many tokens (a signed byte) it changes the count.

        In their order neighbours begin alike, and what is known of a beginning stays.
        """
        size, pairs, ends = self.size, self.pairs, self.ends
        last, counts, before_it = [size], [0], ""
        for segment in sorted(segments):
            same = 0
            for a, b in zip(segment, before_it, strict=False):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], counts[same + 1 :]
            before_it = segment
            for end in range(same + 1, len(segment) + 1):
                start, before, found = end, ends, []
                while start:  # the pieces that end here, the longest last
                    node = before.get(segment[start - 1])
                    if node is None:
                        break
                    start -= 1
                    piece, before = node
                    if piece >= 0:
                        found.append((start, piece))
                for start, piece in reversed(found):
                    key = last[start] * size + piece
                    stays = pairs.get(key)
                    if stays is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        stays = pairs[key] = self.follows(last[start], piece)
                    if stays:
                        last.append(piece)
                        counts.append(counts[start] + 1)
                        break
                else:
                    if found:
                        raise ValueError(f"no piece ends {segment[:end]!r}")
                    last.append(size)  # a letter of no piece is its bytes
                    counts.append(counts[-1] + len(segment[end - 1].encode()))
            self.segments[segment] = np.diff(counts).astype(np.int8).tobytes() if len(segment) > SHORT else bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)])

    def prefixes(self, texts: list[str]) -> list[np.ndarray]:
        """The changes of the count by each code point of the texts."""
        if len(self.segments) >= SEGMENTS:
            self.segments, self.older = {}, self.segments
        split = [SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        new = []
        for segment in set().union(*split):
            if segment not in self.segments:
                known = self.older.get(segment)
                if known is None:
                    new.append(segment)
                else:
                    self.segments[segment] = known
        self._learn(new)
        made = []
        for parts in split:
            flat = np.frombuffer(b"".join(map(self.segments.__getitem__, parts)), dtype=np.int8)
            one = flat[1:].copy()
            if len(flat):
                one[0] += flat[0]  # the space before the text
            made.append(one)
        for segment in new:
            if len(segment) > SHORT:
                del self.segments[segment]
        return made


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def counted(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, n_bytes, n_chars, n_tokens, and prefixes (packed counts of every prefix) of whole texts.

    Tokens are those of the model at ``path``, which every executor can open, without begin, end or
    other special tokens; their strings in a text are ordinary text. A null text is an empty one,
    which has no tokens. Texts of any length take time in proportion to it. Repeated rows give
    repeated results, an empty table an empty one; columns that are not in ``keep`` do not matter,
    and those in it must not be named as the new ones.
    """
    own = T.StructType.fromDDL("n_bytes long, n_chars long, n_tokens long, prefixes binary")
    if {k.lower() for k in keep} & set(own.names):
        raise ValueError(f"columns to keep must not be named {', '.join(own.names)}")
    schema = T.StructType([docs.schema[k] for k in keep] + own.fields)

    def run(batches):
        of = vocabulary(path).prefixes
        for batch in gathered(batches, len(keep)):
            texts = [text or "" for text in batch.column(len(keep)).to_pylist()]
            sizes, lengths, tokens, packed = [], [], [], []
            for text, changes in zip(texts, of(texts), strict=True):
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                lengths.append(len(text))
                tokens.append(int(changes.sum(dtype=np.int64)))
                packed.append(squeeze(changes.tobytes()))
            made = [pa.array(x, pa.int64()) for x in (sizes, lengths, tokens)] + [pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *made], names=schema.names)

    return docs.select(*(F.col(f"`{k}`").alias(f"keep{i}") for i, k in enumerate(keep)), F.col(f"`{text_col}`").alias("text")).mapInArrow(lean(run), schema)


def _answered(table: DataFrame, asked: Column, name: str, answer) -> DataFrame:
    """All columns but prefixes of a counted table and ``name``: answer(counts of the prefixes from 0 on, what is asked)."""
    kept = [f for f in table.schema.fields if f.name not in ("prefixes", name)]
    schema = T.StructType([*kept, T.StructField(name, T.LongType())])

    def run(batches):
        for batch in batches:
            packed, wanted = batch.column(len(kept)), batch.column(len(kept) + 1)
            made = []
            for i in range(batch.num_rows):
                want = wanted[i].as_py()
                made.append(None if want is None else answer(np.concatenate([[0], np.cumsum(np.frombuffer(expand(packed[i].as_py()), dtype=np.int8), dtype=np.int64)]), want))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(made, pa.int64())], names=schema.names)

    return table.select(*(F.col(f"`{f.name}`").alias(f"keep{i}") for i, f in enumerate(kept)), "prefixes", asked.cast("long").alias("asked")).mapInArrow(lean(run), schema)


def truncated(table: DataFrame, limit: Column, name: str = "chars_in_limit") -> DataFrame:
    """A counted table with the code points of the longest prefix of at most ``limit`` tokens, and without prefixes.

    ``limit`` may differ by row: a budget a source, or what is left of a window. A null limit has a
    null answer, one below 0 is answered by 0.
    """
    return _answered(table, limit, name, lambda counts, most: int(np.flatnonzero(counts <= max(most, 0))[-1]))


def tokens_before(table: DataFrame, chars: Column, name: str = "tokens_before") -> DataFrame:
    """A counted table with the tokens of the first ``chars`` code points, of the whole text beyond its end."""
    return _answered(table, chars, name, lambda counts, at: int(counts[min(max(at, 0), len(counts) - 1)]))


#: The tokens of a window, for the query.
LIMIT = 4096


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens, chars_in_limit and over_limit of documents, see ``counted`` and ``truncated``."""
    fitted = truncated(counted(docs, path, ["doc_id"]), F.lit(LIMIT))
    return fitted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
