"""Token counts: count-only Viterbi of a unigram vocabulary, with Aho-Corasick matches and the tokenizer's tie rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairnlink.llm.tokens import NOT_SPACE, Words, column_bytes, hash_ranges, sliced

#: Fixed values of the public tokenizer: the mark that stands for a space, and what an unknown character costs below the least score.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
_KNOWN_BYTES = 64 << 20
#: The counter and the counted parts of a Python worker, by vocabulary; tasks that follow start warm.
_WARM: dict = {}


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of the best segmentation, without building it."""

    def __init__(self, pieces: list[tuple[str, float]], unknown_id: int = 0) -> None:
        self.matcher = ahocorasick.Automaton()
        scores = {}
        for i, (piece, score) in enumerate(pieces):
            if piece and i != unknown_id:
                scores[piece] = score
        for piece, score in scores.items():
            self.matcher.add_word(piece, (len(piece), float(score)))
        self.matcher.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.bytes = all(f"<0x{i:02X}>" in names for i in range(256))
        self.longest = max(map(len, scores), default=1)

    def count(self, text: str) -> int:
        """Pieces of one text. Memory is the text and a ring of as many places as the longest piece has characters.

        best[i] is the best score of the first i characters and used[i] its piece count. Ways to a position are tried from the
        longest piece to the shortest and only a better score replaces one, so of equal scores the longest last piece
        stays; a character that is no piece itself is unknown and tried last. A run of unknown characters is as many
        pieces as it has bytes, or one if the vocabulary has no byte pieces.
        """
        room = self.longest + 1  # no piece reaches further back
        best, used, stray = [0.0] * room, [0] * room, [False] * room
        matches = self.matcher.iter(text) if len(self.matcher) else iter(())
        coming = next(matches, None)
        for at in range(1, len(text) + 1):
            ways = []
            while coming is not None and coming[0] + 1 == at:
                ways.append(coming[1])
                coming = next(matches, None)
            if len(ways) > 1:
                ways.sort(reverse=True)
            top, count, single, unknown = None, 0, False, False
            for size, score in ways:
                single |= size == 1
                value = best[(at - size) % room] + score
                if top is None or value > top:
                    top, count = value, used[(at - size) % room] + 1
            if not single:
                before = (at - 1) % room
                value = best[before] + self.unknown
                if top is None or value > top:
                    top, unknown = value, True
                    count = used[before] + (len(text[at - 1].encode()) if self.bytes else int(not stray[before]))
            here = at % room
            best[here], used[here], stray[here] = top, count, unknown
        return used[len(text) % room]


def _marked_words(texts: pa.Array) -> Words:
    """Texts cut before every space (the spaces are bytes of the words); a text that does not begin with one has a first word."""
    data, base = column_bytes(texts)
    body = data[:-8]
    cut = body == 0x20
    begins = base[:-1][np.diff(base) > 0]
    cut[begins] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(body))
    return Words(data, start, end, np.searchsorted(start, base), base)


def count_tokens(docs: DataFrame, model_file: str, text_column: str = "text", name: str = "n_tokens") -> DataFrame:
    """Add the number of pieces that a unigram tokenizer with the vocabulary and scores of ``model_file`` makes of each text.

    The tokenizer puts a mark for every space and one ahead of a text that has none there, cuts ahead of every mark, and
    takes the best-scoring segmentation of each part. Equal parts of a stretch of texts are segmented once; a worker
    remembers some 64 MB more. Part lengths are not limited; the work is linear in them.

    Null and empty texts have no pieces. Repeated rows are counted alike; an empty table gives an empty result. A column
    named ``name`` is replaced; all others stay.
    """
    docs = docs.drop(name)
    pieces, mark = docs.sparkSession.sparkContext.broadcast(vocabulary(model_file)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _WARM:
            _WARM.clear()
            _WARM[mark] = (Counter(pieces.value), {}, [0])
        counter, known, held = _WARM[mark]
        for batch in sliced(batches, text_column):
            found = _marked_words(batch.column(text_column))
            keys, at, back = np.unique(hash_ranges(found.data, found.start, found.end), return_index=True, return_inverse=True)
            raw, sizes = memoryview(found.data), np.zeros(len(keys), np.int64)
            for i, (low, high) in enumerate(zip(found.start[at].tolist(), found.end[at].tolist())):
                part = bytes(raw[low:high])
                size = known.get(part)
                if size is None:
                    text = part.decode()
                    size = counter.count(MARK + text[1:] if text[0] == " " else MARK + text if text[0] != MARK else text)
                    if held[0] >= _KNOWN_BYTES:
                        known.clear()
                        held[0] = 0
                    held[0] += len(part) + 150
                    known[part] = size
                sizes[i] = size
            total = np.append(0, np.cumsum(sizes[back]))
            yield batch.append_column(name, pa.array(total[found.first[1:]] - total[found.first[:-1]]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{name}` long")
