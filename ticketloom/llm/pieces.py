"""SentencePiece encoding with N-best segmentations, and decoding.

A text, with a space put before it and every space shown as the word mark, is a lattice: an edge for
each vocabulary piece at each place. The best paths are found exactly: a forward Viterbi pass gives
the best score from the start to each place, and an A-star search from the end backwards uses
those scores as its heuristic. As the heuristic is exact, the search expands no path that is not a
prefix of an answer (ties aside). No piece crosses from a word into the next word mark, nor a
newline (checked when a model is read), so a text's lattice is a chain of short chunks; chunks are
searched many at a time in numpy, remembered, and their N best are combined to the text's N best.

Piece scores follow the model's ranks by Zipf's law, in millionths of a nat, as integers: the model
file's own scores are merge ranks and no probabilities. A character without a piece is spelled in
byte pieces, as is a literal word mark; so decoding gives back every text exactly.

Ties go to the path found first: fewer characters in the last differing piece, from the end. Null
and empty texts have no pieces and one segmentation of score 0. Repeated rows give repeated results.
Chunks of any length are allowed; those over LONG characters are searched one by one.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm import arrays
from ticketloom.llm.worker_memory import remembered

MARK = "▁"
LITERAL_MARK = "\ud800"  # a lone surrogate, which no text holds, stands for a word mark in the text
MICRO = 1_000_000
#: Longest chunk that is searched together with others, and the lattice cells of one such search.
LONG = 24
BATCH_CELLS = 300_000
CACHE_CHUNKS = 300_000
NONE = -(1 << 50)
FAR = 1 << 50

_CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Vocabulary:
    """Pieces, integer scores and a trie in sorted arrays."""

    def __init__(self, path: str):
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_file=path)
        n = held.get_piece_size()
        self.text = [b""] * n
        self.bytes_at = [-1] * 256
        pieces: dict[str, tuple[int, int]] = {}
        worst = 0
        for i in range(n):
            piece = held.id_to_piece(i)
            if held.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (held.is_control(i) or held.is_unknown(i) or held.is_unused(i)):
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {i} crosses words")
                rank = min(-held.get_score(i), float(n))
                pieces[piece] = (i, -round(MICRO * math.log(2 + rank)))
                worst = min(worst, pieces[piece][1])
                self.text[i] = piece.replace(MARK, " ").encode()
        if min(self.bytes_at) < 0:
            raise ValueError("the model has no byte pieces")
        self.pieces, self.byte_score = pieces, 2 * worst
        self.longest = max(map(len, pieces))
        nodes: dict[str, int] = {"": 0}
        edges = []
        for piece in sorted(pieces):
            for k in range(1, len(piece) + 1):
                prefix = piece[:k]
                if prefix not in nodes:
                    nodes[prefix] = len(nodes)
                    edges.append(((nodes[prefix[:-1]] << 21) | ord(prefix[-1]), nodes[prefix]))
        edges.sort()
        self.keys = np.array([e[0] for e in edges], dtype=np.int64)
        self.next = np.array([e[1] for e in edges], dtype=np.int64)
        self.node_piece = np.full(len(nodes), -1, dtype=np.int32)
        self.node_score = np.full(len(nodes), NONE, dtype=np.int64)
        for piece, (i, score) in pieces.items():
            self.node_piece[nodes[piece]] = i
            self.node_score[nodes[piece]] = score

    def spelled(self, char: str) -> list[int]:
        return [self.bytes_at[b] for b in (MARK if char == LITERAL_MARK else char).encode()]

    def ids(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        return [known[0]] if known else self.spelled(piece)

    def edge(self, piece: str) -> int | None:
        known = self.pieces.get(piece)
        if known:
            return known[1]
        return self.byte_score * len(self.spelled(piece)) if len(piece) == 1 else None

    def coded(self, cut) -> bytes:
        return np.array([i for piece in cut for i in self.ids(piece)], dtype="<u4").tobytes()

    def decode(self, ids) -> str:
        """The text of a segmentation, without the space put before it."""
        data = b"".join(map(self.text.__getitem__, ids))
        return data[1:].decode("utf-8", "replace")


def search_one(vocabulary: Vocabulary, chunk: str, n: int) -> list[tuple[int, list[str]]]:
    """Best n segmentations of one chunk: forward Viterbi, then A-star from the end."""
    size = len(chunk)
    edges: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    ahead = [NONE] * (size + 1)
    ahead[0] = 0
    for end in range(1, size + 1):
        for length in range(1, min(vocabulary.longest, end) + 1):
            score = vocabulary.edge(chunk[end - length:end])
            if score is not None:
                edges[end].append((length, score))
                ahead[end] = max(ahead[end], ahead[end - length] + score)
    heap, order, out = [(-ahead[size], 0, size, 0, None)], 1, []
    while heap and len(out) < n:
        total, _, at, behind, path = heapq.heappop(heap)
        if not at:
            cut = []
            while path:
                cut.append(chunk[path[0]:path[1]])
                path = path[2]
            out.append((-total, cut))
            continue
        for length, score in edges[at]:
            left = behind + score
            heapq.heappush(heap, (-(left + ahead[at - length]), order, at - length, left,
                                  (at - length, at, path)))
            order += 1
    return out


def search_many(vocabulary: Vocabulary, chunks: list[str], n: int) -> tuple[np.ndarray, list]:
    """The same for chunks of one length at a time: (scores, count x n; each chunk's paths, ids as bytes)."""
    scores, ranked = search_ranked(vocabulary, chunks, n)
    return scores, [[paths[i] for paths, s in zip(ranked, row) if s > NONE]
                    for i, row in enumerate(scores.tolist())]


def search_ranked(vocabulary: Vocabulary, chunks: list[str], n: int) -> tuple[np.ndarray, list[list[bytes]]]:
    """The scores, count x n, and a list of all chunks' best paths, one of their second best and so on.

    A chunk without so many paths has score NONE and no ids there.

    With an exact heuristic a popped path's best extension has the path's own bound and would be
    popped next, down to the start. So each step takes the best open sidetrack, follows the best
    edges from there to the start, and opens the sidetracks along that walk.
    """
    count, size = len(chunks), len(chunks[0])
    most = min(vocabulary.longest, size)
    codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = codes.reshape(count, size).T.astype(np.int64).ravel()  # place by place, all chunks of a place
    score = np.full((size + 1, most + 1, count), NONE, dtype=np.int64)
    piece = np.full((size + 1, most + 1, count), -1, dtype=np.int32)
    flat_score, flat_piece = score.reshape(-1), piece.reshape(-1)
    at = np.arange(size * count)  # start * count + chunk
    node = np.zeros(size * count, dtype=np.int64)
    spelled = np.zeros(count, dtype=bool)
    for length in range(1, most + 1):
        if length > 1:
            fits = np.searchsorted(at, (size - length + 1) * count)
            at, node = at[:fits], node[:fits]
        key = (node << 21) | codes[at + (length - 1) * count]
        edge = np.minimum(np.searchsorted(vocabulary.keys, key), len(vocabulary.keys) - 1)
        found = vocabulary.keys[edge] == key
        if length == 1:
            alone = np.where(found, vocabulary.node_score[vocabulary.next[edge]], NONE)
            bare = np.flatnonzero(alone == NONE)
            for i in bare.tolist():
                alone[i] = vocabulary.byte_score * len(vocabulary.spelled(chunks[i % count][i // count]))
            spelled[bare % count] = True
            score[1:, 1] = alone.reshape(size, count)
        at, node = at[found], vocabulary.next[edge[found]]
        if not len(at):
            break
        start, row = np.divmod(at, count)
        cell = ((start + length) * (most + 1) + length) * count + row
        if length > 1:
            flat_score[cell] = vocabulary.node_score[node]
        flat_piece[cell] = vocabulary.node_piece[node]

    # ahead: forward Viterbi. Of the edges into a place the n best are kept, shorter ones first at equal
    # scores: no more than n - 1 sidetracks of one place can be taken. A key is a score and a length.
    ahead = np.zeros((size + 1, count), dtype=np.int64)
    loss = np.full((count, size + 1, max(n - 1, 1)), FAR, dtype=np.int64)
    lengths = np.zeros((count, size + 1, max(n - 1, 1)), dtype=np.int64)
    step = np.zeros((count, size + 1), dtype=np.int64)
    line = np.arange(count)
    for end in range(1, size + 1):
        kept: list[np.ndarray] = []
        for length in range(1, min(most, end) + 1):
            key = ((ahead[end - length] + score[end, length]) << 6) + (63 - length)
            for j, other in enumerate(kept):
                kept[j], key = np.maximum(other, key), np.minimum(other, key)
            if len(kept) < n:
                kept.append(key)
        ahead[end] = kept[0] >> 6
        step[:, end] = 63 - (kept[0] & 63)
        for j, key in enumerate(kept[1:]):  # the best edge is no sidetrack
            into = key >> 6
            loss[:, end, j] = np.where(into > NONE // 2, ahead[end] - into, FAR)
            lengths[:, end, j] = 63 - (key & 63)

    def walk(at: np.ndarray) -> np.ndarray:
        """Places on the best path from `at` to the start."""
        on = np.zeros((count, size + 1), dtype=bool)
        at = at.copy()
        for _ in range(size + 1):
            on[line, at] = True
            if not at.any():
                break
            at -= step[line, at]
        return on

    sides = loss.shape[2]
    width = (size + 1) * sides
    scores = np.full((count, n), NONE, dtype=np.int64)
    cuts = [walk(np.full(count, size))]
    scores[:, 0] = ahead[size]
    open_ = np.full((count, n * width), FAR, dtype=np.int64)
    for k in range(1, n):
        held = scores[:, 0] - scores[:, k - 1]  # what the last path lost
        fresh = np.where(cuts[-1][:, :, None] if k == 1 else own[:, :, None], loss + held[:, None, None], FAR)
        fresh[held > FAR // 2] = FAR
        open_[:, (k - 1) * width:k * width] = np.minimum(fresh, FAR).reshape(count, width)
        pick = open_[:, :k * width].argmin(axis=1)
        lost = open_[line, pick]
        open_[line, pick] = FAR
        some = lost < FAR
        parent, at = pick // width, pick % width // sides
        length = lengths[line, at, pick % sides]
        own = walk(np.where(some, at - length, 0))
        before = np.stack(cuts)[parent, line]
        cuts.append(before & (np.arange(size + 1) >= at[:, None]) | own)
        scores[:, k] = np.where(some, scores[:, 0] - lost, NONE)

    ranked: list[list[bytes]] = []
    for k, cut in enumerate(cuts):
        r, end = np.nonzero(cut)
        inner = end > 0
        begin = np.append(0, end[:-1])[inner]
        r, end = r[inner], end[inner]
        flat = piece[end, end - begin, r].astype("<u4").tobytes()
        ends = (np.searchsorted(r, np.arange(count + 1)) * 4).tolist()
        paths = [flat[i:j] for i, j in zip(ends, ends[1:])]
        for i in np.flatnonzero(scores[:, k] == NONE).tolist():
            paths[i] = b""
        for i in np.flatnonzero((scores[:, k] > NONE) & spelled).tolist():
            places = np.flatnonzero(cut[i]).tolist()
            paths[i] = vocabulary.coded(chunks[i][a:b] for a, b in zip(places, places[1:]))
        ranked.append(paths)
    return scores, ranked


class Encoder:
    """N-best segmentation of texts; remembers chunks."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.vocabulary, self.n = vocabulary, n
        self.forget()

    def forget(self):
        self.index: dict[str, int] = {}
        self.ranked: list[list[bytes]] = [[] for _ in range(self.n)]
        self.scores = np.zeros((0, self.n), dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)  # bytes of the best path
        self.met = np.zeros(0, dtype=bool)  # in a slice after the one that brought the chunk

    def _make_room(self):
        """Forget the chunks that were not met again; all, if the others would fill more than half."""
        held = np.flatnonzero(self.met)
        if len(held) > CACHE_CHUNKS // 2:
            return self.forget()
        names = list(self.index)  # in the order of their numbers
        self.index = {names[i]: k for k, i in enumerate(held.tolist())}
        self.ranked = [[paths[i] for i in held.tolist()] for paths in self.ranked]
        self.scores, self.sizes = self.scores[held], self.sizes[held]
        self.met = np.zeros(len(held), dtype=bool)

    def _learn(self, chunks: list[str]):
        by_size: dict[int, list[str]] = {}
        for chunk in chunks:
            by_size.setdefault(len(chunk), []).append(chunk)
        tables = [self.scores]
        for size, some in by_size.items():
            if size > LONG:
                found = [search_one(self.vocabulary, c, self.n) for c in some]
                table = np.full((len(some), self.n), NONE, dtype=np.int64)
                for i, paths in enumerate(found):
                    table[i, :len(paths)] = [s for s, _ in paths]
                self._keep(some, [[self.vocabulary.coded(paths[k][1]) if k < len(paths) else b"" for paths in found]
                                  for k in range(self.n)])
                tables.append(table)
                continue
            batch = max(100, BATCH_CELLS // (size + 1) ** 2)
            for i in range(0, len(some), batch):
                table, ranked = search_ranked(self.vocabulary, some[i:i + batch], self.n)
                self._keep(some[i:i + batch], ranked)
                tables.append(table)
        self.scores = np.concatenate(tables)
        fresh = self.ranked[0][len(self.sizes):]
        self.sizes = np.append(self.sizes, np.fromiter(map(len, fresh), np.int64, len(fresh)))
        self.met = np.append(self.met, np.zeros(len(chunks), dtype=bool))

    def _keep(self, chunks: list[str], ranked: list[list[bytes]]):
        base = len(self.index)
        self.index.update(zip(chunks, range(base, base + len(chunks))))
        for held, paths in zip(self.ranked, ranked):
            held += paths

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """Each chunk's number, after those not known were learned."""
        numbers, unknown = self._looked_up(chunks)
        new = {chunks[i] for i in unknown}
        if len(self.index) + len(new) > CACHE_CHUNKS:
            self._make_room()
            numbers, unknown = self._looked_up(chunks)
            new = {chunks[i] for i in unknown}
            if len(self.index) + len(new) > CACHE_CHUNKS:
                self.forget()
                numbers, unknown = self._looked_up(chunks)
                new = set(chunks)
        self.met[numbers[numbers >= 0]] = True
        if new:
            self._learn(sorted(new))
            place = self.index.__getitem__
            numbers[unknown] = [place(chunks[i]) for i in unknown]
        return numbers

    def _looked_up(self, chunks: list[str]) -> tuple[np.ndarray, list[int]]:
        """The numbers of known chunks, -1 for others, and where the others are."""
        numbers = np.fromiter(map(self.index.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        return numbers, np.flatnonzero(numbers < 0).tolist()

    def __call__(self, texts: list[str | None]) -> list[list[tuple[int, bytes]]]:
        """Per text its best n segmentations: (score, ids as little-endian unsigned 32 bits)."""
        split = [_CHUNK.findall(MARK + t.replace(MARK, LITERAL_MARK).replace(" ", MARK)) if t
                 else [] for t in texts]
        numbers = self._numbers(list(itertools.chain.from_iterable(split)))
        ends = list(itertools.accumulate(map(len, split), initial=0))
        return [self._combined(numbers[i:j]) for i, j in zip(ends, ends[1:])]

    def _combined(self, chunks: np.ndarray) -> list[tuple[int, bytes]]:
        if not len(chunks):
            return [(0, b"")]
        best = b"".join(map(self.ranked[0].__getitem__, chunks.tolist()))
        scores = self.scores[chunks]
        top = int(scores[:, 0].sum())
        out = [(0, ())]  # (loss, changed places)
        if self.n > 1:
            nearest = np.argsort(scores[:, 0] - scores[:, 1], kind="stable")[:self.n - 1]
            for place in sorted(nearest.tolist()):
                row = scores[place].tolist()
                levels = [(row[0] - s, j) for j, s in enumerate(row) if s > NONE]
                out = sorted((loss + more, changed + (((place, j),) if j else ()))
                             for loss, changed in out for more, j in levels)[:self.n]
        ends = self.sizes[chunks].cumsum()
        result = []
        for loss, changed in out:
            parts, after = [], 0
            for place, j in changed:
                end = int(ends[place])
                parts += best[after:end - int(self.sizes[chunks[place]])], self.ranked[j][chunks[place]]
                after = end
            result.append((top - loss, b"".join([*parts, best[after:]])))
        return result


def encoder(path: str, n: int) -> Encoder:
    """The worker's encoder for a model file and n."""
    return remembered(("pieces", path, n), lambda: Encoder(Vocabulary(path), n))


ADDED = T.StructType([
    T.StructField("n_pieces", T.LongType()), T.StructField("piece_score", T.LongType()),
    T.StructField("piece_crc32", T.LongType()), T.StructField("nbest_scores", T.ArrayType(T.LongType())),
    T.StructField("nbest_crc32", T.ArrayType(T.LongType())), T.StructField("round_trip", T.BooleanType()),
    T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])


def with_pieces(df: DataFrame, path: str, text: str = "text", n: int = 3, ids: bool = True) -> DataFrame:
    """`df` with its best segmentation, the scores and checksums of its n best, and whether decoding
    the best gives the text back. Columns of those names are replaced. One pass without a shuffle."""
    added = [f for f in ADDED if ids or f.name != "piece_ids"]
    kept = [c for c in df.columns if c not in {f.name for f in added}]
    schema = T.StructType([*(df.schema[c] for c in kept), *added])
    whole = f"whole_{uuid.uuid4().hex}"  # whatever other columns are called
    rows = df.select(*kept, F.col(text).cast("string").alias(whole))

    def encode(batches):
        coder = encoder(path, n)
        decode = coder.vocabulary.decode
        for part in arrays.slices(batches, whole):
            texts = part.column(whole).to_pylist()
            found = coder(texts)
            best = [np.frombuffer(f[0][1], dtype="<u4") for f in found]
            columns = [part.column(i) for i in range(len(kept))] + [
                pa.array([len(b) for b in best], pa.int64()),
                pa.array([f[0][0] for f in found], pa.int64()),
                pa.array([zlib.crc32(f[0][1]) for f in found], pa.int64()),
                pa.array([[s for s, _ in f] for f in found], pa.list_(pa.int64())),
                pa.array([[zlib.crc32(x) for _, x in f] for f in found], pa.list_(pa.int64())),
                pa.array([decode(b.tolist()) == (t or "") for b, t in zip(best, texts)])]
            if ids:
                ends = np.concatenate([[0], np.cumsum([len(b) for b in best])]).astype(np.int32)
                flat = np.concatenate(best).astype(np.int32) if best else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=kept + [f.name for f in added])

    return rows.mapInArrow(encode, schema)


def digest(docs: DataFrame, path: str, n: int = 3) -> DataFrame:
    return with_pieces(docs.select("doc_id", "text"), path, n=n, ids=False).drop("text")
