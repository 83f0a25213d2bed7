"""Operator 4, SentencePiece encoding and decoding: Gumbel top-k sampling of segmentations without replacement.

Encoding.  A text is written as SentencePiece does: spaces as U+2581, one more in front.  Two letters that are side by
side in no piece are always cut apart, so the text's lattice is a chain of the lattices of the stretches between such
letters, its words below; no piece of the vocabularies meant here has the mark behind another letter.  Each way
through the lattice, i.e. each segmentation, has the product of its pieces' weights; a piece's weight falls with its
rank in the vocabulary (rank + 10) ** -alpha.  Letters without a piece are their UTF-8 bytes' pieces.  Backward sums
over the lattice make each step's choice a conditional probability.

Sampling.  Perturbing every segmentation's log-probability with Gumbel noise and taking the k largest is sampling
without replacement; an A-star search finds them without listing segmentations.  A node is a beginning of a
segmentation, its bound the largest perturbed value of all that begin so; the root's is a Gumbel.  Below a node, the
choice with the bound itself is drawn by probability, and the rest of the choices together get a Gumbel of their
total probability, cut off at the node's bound.  So a way to an end costs one pass, leaving at each step one open set
("all other choices here"); the best open set is next: one of its choices is drawn, the text behind it anew.  Sets
so far behind that they can't be the best aren't drawn.  Every step is vectorised over all words of a block of texts.
Words are found by hash and compared; their lattices are kept for later blocks of the task, up to MAX_NODES letters; a
block's own words are always held, so a text without spaces needs about 150 bytes a letter.

Noise is a hash of the row's key, the sample's number and the place, so results don't depend on how rows are dealt
out.  The best set that is open after k ways has the next one's perturbed value as its bound: the threshold t by which
a segmentation of log-probability p has inclusion probability 1 - exp(-exp(p - t)).

Decoding joins pieces, gathers byte pieces, and takes back the mark and the added space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import mix, task

SPACE = "▁"
BLOCK_CHARS = 300_000
BATCH_EDGES = 1 << 24
DECODED_AT_ONCE = 1 << 14
PAIRS = 1 << 24
NEAR = 45.0
MOST_NOISE = 38.0  # a set's bound is at most its log-probability - log(-log(1 - 2 ** -53))
MAX_NODES = 600_000  # letters of different words whose lattices a task holds; about 150 bytes each
_FACTORS = mix(mix(np.arange(1, 257, dtype=np.uint64))) | np.uint64(1)
_models: dict = {}


class _Table:
    """A hash table of numbers >= 0 to numbers with linear probing, whole arrays at a time."""

    def __init__(self, room: int = 1 << 12):
        self._make(room)

    def _make(self, room: int) -> None:
        size = 1 << int(np.ceil(np.log2(max(16, 4 * room))))
        self.shift, self.mask, self.many = np.uint64(64 - int(np.log2(size))), size - 1, 0
        self.slots, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are different and not there yet."""
        if 2 * (self.many + len(keys)) > len(self.slots):
            have = np.flatnonzero(self.slots >= 0)
            keys, values = np.concatenate([self.slots[have], keys]), np.concatenate([self.values[have], values])
            self._make(len(keys))
        self.many += len(keys)
        left, place = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.slots[place] < 0)
            self.slots[place[free]] = keys[left[free]]  # of several for one place, one is written
            taken = free[self.slots[place[free]] == keys[left[free]]]
            self.values[place[taken]] = values[left[taken]]
            stay = np.ones(len(left), bool)
            stay[taken] = False
            left, place = left[stay], (place[stay] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys, -1 for none."""
        place = self._slot(keys)
        found = self.slots[place]
        hit = found == keys
        out = np.where(hit, self.values[place], np.int32(-1))
        left = np.flatnonzero(~hit & (found >= 0))
        place = place[left]
        while len(left):
            place = (place + 1) & self.mask
            found = self.slots[place]
            hit = found == keys[left]
            out[left[hit]] = self.values[place[hit]]
            more = ~hit & (found >= 0)
            left, place = left[more], place[more]
        return out


class Vocabulary:
    """Pieces of a SentencePiece model as a trie over letters, with weights by rank."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("the vocabulary has pieces that run over spaces")
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("the vocabulary has no pieces for bytes")
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.byte_id = np.array([self.bytes[b] for b in range(256)], np.int32)
        self.byte_weight = -alpha * np.log(n + 10.0)
        weight = {i: -alpha * np.log(rank + 10.0) for rank, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        letters = sorted({c for i in plain for c in self.pieces[i]})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        edges: dict[tuple[int, int], int] = {}
        ends, values = [-1], [0.0]
        for i in plain:
            state = 0
            for c in self.pieces[i]:
                key = state, int(self.code[ord(c)])
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                    values.append(0.0)
                state = edges[key]
            ends[state], values[state] = i, weight[i]
        self.width = len(letters) + 1
        keys = np.array([s * self.width + c for s, c in edges], np.int64)
        self.steps = _Table(len(keys))  # (state, letter) -> state
        self.steps.insert(keys, np.array(list(edges.values()), np.int32))
        first = np.zeros(self.width, np.int32)  # the first step by letter, later ones by hash
        for (s, c), t in edges.items():
            if s == 0:
                first[c] = t
        self.first, self.end, self.value = first, np.array(ends, np.int32), np.array(values)
        beside = {p[j : j + 2] for p in (self.pieces[i] for i in plain) for j in range(len(p) - 1)}
        self.pairs = np.zeros(min(self.width**2, PAIRS), bool)
        for pair in beside:
            self.pairs[self._pair(self.code[[ord(c) for c in pair]])] = True

    def _pair(self, code: np.ndarray) -> np.ndarray:
        """A number for each letter and the next one; pairs share one only where there are too many letters."""
        key = code[:-1].astype(np.int64) * self.width + code[1:]
        return key if self.width**2 <= PAIRS else key % PAIRS

    def breaks(self, letters: np.ndarray) -> np.ndarray:
        """For each letter but the last, whether no piece has it and the next one; where pairs share a number some are missed."""
        return ~self.pairs[self._pair(self.code[letters])]


def vocabulary(path: str, alpha: float) -> Vocabulary:
    if (path, alpha) not in _models:
        _models[path, alpha] = Vocabulary(path, alpha)
    return _models[path, alpha]


class Lattice:
    """Edges of the lattices of different words, added as they are met; node i stands before letter i, words share no edge.

    All values of a node depend on its word alone, so it doesn't matter which words are held beside it.
    """

    def __init__(self, vocab: Vocabulary, limit: int = MAX_NODES):
        self.vocab, self.limit = vocab, limit
        self._free()
        self.clear()

    def _free(self) -> None:
        self.letter, self.left, self.first = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.start, self.stop, self.id = (np.zeros(0, np.int32) for _ in range(3))
        self.logp, self.upto = np.zeros(0), np.zeros(0)

    def clear(self) -> None:
        self.table = _Table()  # hash of a word -> its first node
        self.nodes = self.edges = 0
        if len(self.letter) > 2 * self.limit:  # else its room is used again
            self._free()

    def places(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The first node of each word; unknown ones are added, and if there is no room, what is held goes first.

        Words are stretches of ``letters``, end to end.  They are found by hash and compared letter by letter.
        """
        if not len(starts):
            return np.zeros(0, np.int64)
        within = np.arange(len(letters)) - np.repeat(starts, sizes)
        hashes = word_hashes(letters, within, starts)
        out = self.table.find(hashes).astype(np.int64)
        new = np.flatnonzero(out < 0)
        _, one, back = np.unique(hashes[new], return_index=True, return_inverse=True)
        if self.nodes and self.nodes + sizes[new[one]].sum() > self.limit:
            self.clear()
            new = np.arange(len(starts))
            _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(new):
            some = new[one]
            at = self._add(letters[_ragged(starts[some], sizes[some])], sizes[some])
            self.table.insert(hashes[some], at.astype(np.int32))
            out[new] = at[back]
        wrong = np.flatnonzero(self.letter[np.minimum(np.repeat(out, sizes) + within, self.nodes - 1)] != letters)
        some = np.union1d(np.searchsorted(starts, wrong, side="right") - 1, np.flatnonzero(self.left[out] != sizes))
        if len(some):  # words that share another's hash
            words = [letters[starts[i] : starts[i] + sizes[i]].tobytes() for i in some.tolist()]
            different = list(dict.fromkeys(words))
            at = self._add(np.frombuffer(b"".join(different), np.int32), np.array([len(w) // 4 for w in different]))
            found = dict(zip(different, at.tolist(), strict=True))
            out[some] = [found[w] for w in words]
        return out

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        have = getattr(self, name)
        if at + len(values) > len(have):
            more = np.empty(max(len(have) * 5 // 4, at + len(values)), have.dtype)
            more[:at] = have[:at]
            setattr(self, name, more)
            have = more
        have[at : at + len(values)] = values

    def _add(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Put in words, ``letters`` end to end; gives their first nodes."""
        vocab = self.vocab
        begin = np.cumsum(sizes) - sizes
        ends = np.repeat(begin + sizes, sizes).astype(np.int32)
        n = len(letters)
        code = vocab.code[letters]
        at, state = np.arange(n, dtype=np.int32), vocab.first[code]
        found = []
        depth = 1
        while True:
            alive = state > 0
            at, state = at[alive], state[alive]
            if not len(at):
                break
            id_ = vocab.end[state]
            done = id_ >= 0
            found.append((at[done], depth, id_[done], vocab.value[state[done]]))
            more = at + depth < ends[at]
            at, state = at[more], state[more]
            state = vocab.steps.find(state.astype(np.int64) * vocab.width + code[at + depth])
            depth += 1
        single = np.zeros(n, bool)
        if found:
            single[found[0][0]] = True
        raw = np.flatnonzero(~single).astype(np.int32)  # letters without a piece of their own: their bytes
        many = (~single).astype(np.int32)
        for at, *_ in found:
            many[at] += 1
        first = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        start = np.repeat(np.arange(n, dtype=np.int32), many)
        stop, piece, weight = np.empty(len(start), np.int32), np.empty(len(start), np.int32), np.empty(len(start))
        place = first[:-1].copy()
        found.insert(0, (raw, 1, -1, utf8_size(letters[raw]) * vocab.byte_weight))
        for at, depth, id_, w in reversed(found):  # at each node the longest pieces, mostly the likeliest, come first
            to = place[at]
            stop[to], piece[to], weight[to] = at + depth, id_, w
            place[at] = to + 1
        logp = self._sum_back(ends, first, start, stop, weight)
        upto = self._choices(many, first, logp)
        for name, values in (("start", start + self.nodes), ("stop", stop + self.nodes), ("id", piece), ("logp", logp), ("upto", upto)):
            self._put(name, self.edges, values)
        self._put("letter", self.nodes, letters)
        self._put("left", self.nodes, ends - np.arange(n, dtype=np.int32))  # letters to the word's end
        self._put("first", self.nodes, first + self.edges)
        self.nodes, self.edges = self.nodes + n, self.edges + len(start)
        return begin + (self.nodes - n)

    @staticmethod
    def _sum_back(ends: np.ndarray, first: np.ndarray, start: np.ndarray, stop: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Log-probabilities of the choices, by beta[i]: log of the total weight of ways from node i to its word's end."""
        n = len(ends)
        beta = np.zeros(n + 1)
        left = ends - np.arange(n, dtype=np.int32)
        order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(left))])[1:]
        onward = np.where(stop == ends[start], n, stop)  # beta[n] stays 0
        counts = np.diff(first)[order]
        edge = _ragged(first[order], counts)
        cuts, there, back = np.concatenate([[0], np.cumsum(counts)]), onward[edge], weight[edge]
        del edge
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            x, y = cuts[a], cuts[b]
            cut, value = cuts[a:b] - x, back[x:y] + beta[there[x:y]]
            top = np.maximum.reduceat(value, cut)
            value -= np.repeat(top, counts[a:b])
            beta[order[a:b]] = top + np.log(np.add.reduceat(np.exp(value, out=value), cut))
        return np.minimum(weight + beta[onward] - beta[start], 0.0)

    @staticmethod
    def _choices(many: np.ndarray, first: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """For each choice of a node: the probability of those up to and with it."""
        upto = np.exp(logp)
        node = np.flatnonzero(many > 1)
        edge, deep = first[node], many[node]
        for rank in range(1, int(many.max(initial=1))):
            some = deep > rank
            edge, deep = edge[some], deep[some]
            upto[edge + rank] += upto[edge + rank - 1]
        return upto

    def others(self, edges: np.ndarray) -> np.ndarray:
        """The log-probability of all other choices together at each edge's node, -inf where there are none."""
        node = self.start[edges]
        many = self.first[node + 1] - self.first[node]
        out, several = np.full(len(edges), -np.inf), np.flatnonzero(many > 1)
        if len(several):
            many = many[several]
            cut = np.cumsum(many) - many
            choices = _ragged(self.first[node[several]], many)
            logp = np.where(choices == np.repeat(edges[several], many), -np.inf, self.logp[choices])
            top = np.maximum.reduceat(logp, cut)
            out[several] = top + np.log(np.add.reduceat(np.exp(logp - np.repeat(top, many)), cut))
        return out

    def draw(self, edge: np.ndarray, last: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, of those from its first one to its last, by probability."""
        left = np.flatnonzero(u > self.upto[edge])
        while len(left):
            edge[left] += 1
            left = left[edge[left] < last[left]]
            left = left[u[left] > self.upto[edge[left]]]
        return edge


def word_hashes(letters: np.ndarray, within: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes, as numbers >= 0, of words that lie end to end, from each letter and its place ``within`` its word."""
    each = (letters + np.int32(1)).astype(np.uint64) * _FACTORS[within & 255]
    return (mix(np.add.reduceat(each, starts)) >> np.uint64(1)).view(np.int64)


def utf8_size(letters: np.ndarray) -> np.ndarray:
    return 1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then the same of each other stretch."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _uniform(key: np.ndarray, kind: int, sample: int, at=0) -> np.ndarray:
    """Numbers in (0, 1) from row keys and what tells a draw apart: its kind, the sample's number and a place."""
    place = np.atleast_1d(at).astype(np.uint64) + np.uint64((kind << 56) + (sample << 44))
    x = mix(mix(place + np.uint64(0x632BE59BD9B4E019)) ^ key)
    return np.minimum(((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53), 1 - 2.0**-53)


class Sampler:
    """All texts of a block: words, their shared lattices, and the search."""

    def __init__(self, lattice: Lattice, texts: list[str], keys: np.ndarray):
        self.lattice, self.keys, self.n = lattice, keys, len(texts)
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        text = "".join(marked)
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in marked])]).astype(np.int64)
        begin = np.zeros(len(letters) + 1, bool)
        begin[offsets] = True
        begin[1:-1] |= lattice.vocab.breaks(letters)
        starts = np.flatnonzero(begin[:-1])
        stops = np.append(starts[1:], len(letters)) if len(starts) else starts
        self.word_at, self.doc_at = starts, offsets
        self.first_word = np.searchsorted(starts, offsets)
        self.word_doc = np.repeat(np.arange(self.n), np.diff(self.first_word))
        self.begin = lattice.places(letters, starts, stops - starts)
        self.close = self.begin + (stops - starts)

    def _walk(self, word: np.ndarray, node: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges from ``node`` of each ``word`` (indices) to its end: (word, edge) in the text's order."""
        found_at, found_edge = [], []
        lattice, doc = self.lattice, self.word_doc[word]
        at, close, key = np.arange(len(word)), self.close[word], self.keys[doc]
        shift = self.word_at[word] - self.doc_at[doc] - self.begin[word]  # from nodes to places in the text
        while len(at):
            edge, last = lattice.first[node], lattice.first[node + 1] - 1
            several = np.flatnonzero(edge < last)
            some = at[several]
            u = _uniform(key[some], 1, sample, shift[some] + node[several])
            edge[several] = lattice.draw(edge[several], last[several], u)
            found_at.append(at)
            found_edge.append(edge)
            node = lattice.stop[edge]
            more = node < close[at]
            at, node = at[more], node[more]
        if not found_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts = np.bincount(np.concatenate(found_at), minlength=len(word))
        begin = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), np.int64)
        for step, (at, edge) in enumerate(zip(found_at, found_edge, strict=True)):
            out[begin[at] + step] = edge
        return np.repeat(word, counts), out

    def sample(self, k: int) -> Samples:
        """Up to ``k`` ways through each text's lattice, those of the largest perturbed log-probability first.

        The next way's perturbed log-probability is its set's bound, so ``beyond`` has it without that way.
        """
        lattice, n = self.lattice, self.n
        done = Samples(n)
        sets = _OpenSets(self, done)
        docs, bound = np.arange(n), -np.log(-np.log(_uniform(self.keys, 0, 0)))  # the root: total probability 1
        # the way to take first: ``level`` edges from place ``source`` on, ``pick``, and what is drawn anew behind
        source, level, pick = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        chosen = 0
        word, edge = self._walk(np.arange(len(self.word_at)), self.begin.copy(), 0)
        for s in range(k):
            counts = np.bincount(self.word_doc[word], minlength=n)[docs]
            head = level + chosen
            size = head + counts
            offset = np.concatenate([[0], np.cumsum(size)])
            own, own_word, tail = edge, word, np.arange(len(edge))
            if chosen:
                own, own_word = np.empty(offset[-1], np.int64), np.empty(offset[-1], np.int64)
                tail = _ragged(offset[:-1] + head, counts)
                own[tail], own_word[tail] = edge, word
                to, old = _ragged(offset[:-1], level), _ragged(source, level)
                own[to], own_word[to] = done.edge[old], done.word[old]
                own[offset[:-1] + level], own_word[offset[:-1] + level] = pick, done.word[source + level]
            lp = lattice.logp[own]
            before, total = np.zeros(len(own)), np.zeros(len(docs))  # log-probability of what comes before, of all
            for i, (a, b) in enumerate(zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True)):
                if a < b:  # each text by itself, so that its sums don't depend on its block
                    upto = np.cumsum(lp[a:b])
                    before[a + 1 : b], total[i] = upto[:-1], upto[-1]
            place = done.add(s, docs, total, bound, own, own_word, before, offset)
            # one open set a level that was drawn anew: all other choices there
            sets.wait(docs, bound, place + offset, place + offset[:-1] + head, s + 1)
            docs, bound, place, level, used = sets.best()
            if s + 1 == k:
                done.beyond[docs] = bound
            if s + 1 == k or not len(docs):
                break
            pick = self._pick(sets, done, docs, bound, place, level, used, s + 1)
            source, chosen = place - level, 1
            # behind the pick: the rest of its word, and all words after that
            w, stop = done.word[place], lattice.stop[pick]
            inner = stop < self.close[w]
            from_ = np.where(inner, w, w + 1)
            many = self.first_word[docs + 1] - from_
            word = _ragged(from_, many)
            node = self.begin[word]
            node[(np.cumsum(many) - many)[inner]] = stop[inner]
            word, edge = self._walk(word, node, s + 1)
        return done

    def _pick(self, sets: _OpenSets, done: Samples, docs: np.ndarray, bound: np.ndarray, place: np.ndarray, level: np.ndarray, used: list, sample: int) -> np.ndarray:
        """A choice of each open set by probability; what else is in the set stays open."""
        lattice, taken = self.lattice, done.edge[place]
        node = lattice.start[taken]
        first, many = lattice.first[node], lattice.first[node + 1] - lattice.first[node]
        column = np.arange(many.max())
        edges = first[:, None] + column
        free = (column < many[:, None]) & (edges != taken[:, None])
        for i, more in enumerate(used):
            free[i, [e - first[i] for e in more]] = False
        lp = np.where(free, lattice.logp[np.where(free, edges, 0)], -np.inf)
        p = np.cumsum(np.exp(lp - lp.max(axis=1, keepdims=True)), axis=1)
        u = _uniform(self.keys[docs], 3, sample, level)
        at = np.minimum((p <= (u * p[:, -1])[:, None]).sum(axis=1), len(column) - 1 - free[:, ::-1].argmax(axis=1))
        rows = np.arange(len(docs))
        pick = edges[rows, at]
        lp[rows, at] = -np.inf
        left = np.flatnonzero(free.sum(axis=1) > 1)
        if len(left):
            top = lp[left].max(axis=1)
            mass = done.before[place[left]] + top + np.log(np.exp(lp[left] - top[:, None]).sum(axis=1))
            noise = -np.log(_uniform(self.keys[docs[left]], 4, sample, level[left]))
            sets.add(docs[left], _cut_off(mass, bound[left], noise), place[left], level[left], [(*used[i], int(pick[i])) for i in left.tolist()])
        return pick


def _cut_off(mass: np.ndarray, bound: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The Gumbel of a set of log-probability ``mass``, cut off at ``bound``; ``noise`` is exponential."""
    return mass - np.log(np.exp(np.minimum(mass - bound, 700.0)) + noise)


class Samples:
    """Ways found so far: row i has sample number[i] of doc[i], edges edge[start[i]:start[i] + size[i]].

    ``beyond``: each document's largest perturbed log-probability of the ways that aren't among them, -inf for none.
    """

    def __init__(self, n: int) -> None:
        self.beyond = np.full(n, -np.inf)
        whole = lambda: np.zeros(0, np.int64)
        self.number, self.doc, self.start, self.size, self.edge, self.word = (whole() for _ in range(6))
        self.total, self.bound, self.before = (np.zeros(0) for _ in range(3))

    def add(self, number: int, doc: np.ndarray, total: np.ndarray, bound: np.ndarray, edge: np.ndarray, word: np.ndarray, before: np.ndarray, offset: np.ndarray) -> int:
        place = len(self.edge)
        new = {"number": np.full(len(doc), number), "doc": doc, "start": place + offset[:-1], "size": np.diff(offset), "total": total, "bound": bound, "edge": edge, "word": word, "before": before}
        for name, values in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))
        return place

    def ordered(self) -> np.ndarray:
        return np.lexsort((self.number, self.doc))

    def edges(self, row: int) -> np.ndarray:
        return self.edge[self.start[row] : self.start[row] + self.size[row]]


class _OpenSets:
    """Open sets of all documents: bound, place of the choice in the samples' edges, level; ``used``: choices taken besides.

    Ways' beginnings soon become unlikely, and sets far behind can't have the largest bound: no bound is over the
    log-probability of what comes before by more than MOST_NOISE.  Those of a way with less than NEAR before them wait
    until all other sets of their document are under that.
    """

    def __init__(self, sampler: Sampler, done: Samples) -> None:
        self.sampler, self.done = sampler, done
        self.parts: list[list] = []
        self.waiting: list[list] = []
        self.late = np.full(sampler.n, -np.inf)  # no waiting set of the document has a larger bound

    def add(self, doc: np.ndarray, g: np.ndarray, place: np.ndarray, level: np.ndarray, used: list | None = None) -> None:
        if len(doc):
            self.parts.append([doc, g, place, level, used])

    def wait(self, doc: np.ndarray, bound: np.ndarray, start: np.ndarray, begin: np.ndarray, sample: int) -> None:
        """The sets of one way of each document, that lies at start[i]:start[i + 1], from ``begin`` on; the near ones are opened."""
        before = self.done.before
        near = start[0] + np.flatnonzero(before[start[0] : start[-1]] >= -NEAR)  # the first levels of each way
        middle = np.maximum(np.searchsorted(near, start[1:]) - np.searchsorted(near, start[:-1]) + start[:-1], begin)
        self._open(doc, bound, start[:-1], begin, middle, sample)
        far = np.flatnonzero(middle < start[1:])
        if len(far):
            self.late[doc[far]] = np.maximum(self.late[doc[far]], before[middle[far]] + MOST_NOISE)
            self.waiting.append([doc[far], bound[far], start[far], middle[far], start[far + 1], sample])

    def _open(self, doc: np.ndarray, bound: np.ndarray, start: np.ndarray, begin: np.ndarray, end: np.ndarray, sample: int) -> None:
        counts = end - begin
        place, which = _ragged(begin, counts), np.repeat(np.arange(len(doc)), counts)
        mass = self.done.before[place] + self.sampler.lattice.others(self.done.edge[place])
        open_ = np.flatnonzero(mass > -np.inf)
        mass, which, place = mass[open_], which[open_], place[open_]
        level = place - start[which]
        noise = -np.log(_uniform(self.sampler.keys[doc[which]], 2, sample, level))
        self.add(doc[which], _cut_off(mass, bound[which], noise), place, level)

    def _largest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document the largest bound, its part, and where it is there."""
        n = self.sampler.n
        top, part, where = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, np.int64)
        for i, (doc, g, *_) in enumerate(self.parts):  # a part is sorted by document
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            most = np.maximum.reduceat(g, first)
            at = np.flatnonzero(g == np.repeat(most, np.diff(first, append=len(doc))))
            at = at[np.diff(doc[at], prepend=-1) > 0]
            better = (g[at] > top[doc[at]]) & (g[at] > -np.inf)
            at = at[better]
            top[doc[at]], part[doc[at]], where[doc[at]] = g[at], i, at
        return top, part, where

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
        """(doc, bound, place, level, used) of each document's set of the largest bound, which is taken out."""
        top, part, where = self._largest()
        short = self.late > top
        if short.any():
            for i, (doc, *ways, sample) in enumerate(self.waiting):
                now, later = np.flatnonzero(short[doc]), np.flatnonzero(~short[doc])
                self._open(doc[now], *(x[now] for x in ways), sample)
                self.waiting[i] = [doc[later], *(x[later] for x in ways), sample]
            self.late[short] = -np.inf
            top, part, where = self._largest()
        docs = np.flatnonzero(part >= 0)
        place, level, used = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), [()] * len(docs)
        for i, (_, g, places, levels, taken) in enumerate(self.parts):
            mine = np.flatnonzero(part[docs] == i)
            at = where[docs[mine]]
            place[mine], level[mine], g[at] = places[at], levels[at], -np.inf
            if taken is not None:
                for j, a in zip(mine.tolist(), at.tolist(), strict=True):
                    used[j] = taken[a]
        return docs, top[docs], place, level, used


def piece_ids(lattice: Lattice, edges: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of ways laid end to end (``counts`` edges each), letters without a piece as bytes; and ids a way."""
    out = lattice.id[edges]
    raw = np.flatnonzero(out < 0)
    if len(raw):
        letter = lattice.letter[lattice.start[edges[raw]]]
        size = np.ones(len(edges), np.int64)
        size[raw] = wide = utf8_size(letter)
        ends = np.cumsum(size)
        out, at = np.repeat(out, size), ends[raw] - wide
        for w in range(1, 5):
            some = np.flatnonzero(wide == w)
            for j in range(w):
                bits = letter[some] >> 6 * (w - 1 - j)
                byte = (bits & 0x3F | 0x80) if j else bits | (0, 0, 0xC0, 0xE0, 0xF0)[w]
                out[at[some] + j] = lattice.vocab.byte_id[byte]
        ways = np.concatenate([[0], np.cumsum(counts)])
        counts = np.diff(np.concatenate([[0], ends])[ways])
    return out.astype("<u4"), counts


class Decoder:
    """Texts of piece ids."""

    def __init__(self, vocab: Vocabulary):
        raw = [bytes([vocab.byte_of[i]]) if i in vocab.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(vocab.pieces)]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def _join(self, ids: np.ndarray) -> np.ndarray:
        parts = [ids[a : a + DECODED_AT_ONCE] for a in range(0, len(ids), DECODED_AT_ONCE)]
        found = [self.raw[_ragged(self.start[part], self.size[part])] for part in parts]
        return np.concatenate(found) if found else np.zeros(0, np.uint8)

    def __call__(self, ids: bytes) -> str:
        """The text of ids as little-endian unsigned 32-bit bytes."""
        text = self._join(np.frombuffer(ids, "<u4")).tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def column(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of ids laid end to end, ``counts`` of them each."""
        text = self._join(ids)
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])
        ends = ends[np.concatenate([[0], np.cumsum(counts)])]
        begins = ends[:-1][np.diff(ends) > 0]
        spaces = begins[text[begins] == ord(" ")]
        offsets = (ends - np.searchsorted(spaces, ends)).astype(np.int32)
        data = np.delete(text, spaces)
        out = pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # bytes that aren't UTF-8
            raw = data.tobytes()
            out = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
        return out


_COLUMNS = {"id": pa.int64(), "sample": pa.int32(), "ids": pa.binary(), "log_prob": pa.float64(), "perturbed": pa.float64(), "inclusion": pa.float64()}
_DDL = "id long, sample int, ids binary, log_prob double, perturbed double, inclusion double"


def _rows(sampler: Sampler, ids: pa.Array, k: int, decoder: Decoder | None = None) -> Iterator[pa.RecordBatch]:
    """The samples of a block, in batches of about BATCH_EDGES edges."""
    found = sampler.sample(k)
    order = found.ordered()
    part = np.cumsum(found.size[order]) // BATCH_EDGES
    for rows in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        if not len(rows):
            continue
        size = found.size[rows]
        flat, size = piece_ids(sampler.lattice, found.edge[_ragged(found.start[rows], size)], size)
        offsets = np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
        doc, total = found.doc[rows], found.total[rows]
        inclusion = -np.expm1(-np.exp(np.minimum(total - found.beyond[doc], 700.0)))
        columns = [ids.take(pa.array(doc)), pa.array(found.number[rows], pa.int32()), packed, pa.array(total), pa.array(found.bound[rows]), pa.array(inclusion)]
        fields = list(_COLUMNS.items())
        if decoder:
            columns.append(decoder.column(flat, size))
            fields.append(("decoded", pa.string()))
        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))


def _encode(path: str, k: int, alpha: float, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path, alpha))
        decoder = Decoder(lattice.vocab) if decoded else None
        for batch in batches:
            ids, texts = batch.column("id"), [t or "" for t in batch.column("text").to_pylist()]
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            a = size = 0
            for b, t in enumerate(texts):
                size += len(t)
                if size >= BLOCK_CHARS or b + 1 == len(texts):
                    yield from _rows(Sampler(lattice, texts[a : b + 1], keys[a : b + 1]), ids.slice(a, b + 1 - a), k, decoder)
                    a, size = b + 1, 0

    return task(run)


def sample_encodings(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", k: int = 2, alpha: float = 1.0, seed: int = 0, decoded: bool = False) -> DataFrame:
    """Up to ``k`` different segmentations of each row: (``id_col``, sample, ids, log_prob, perturbed, inclusion).

    ``ids``: piece ids as little-endian unsigned 32-bit bytes; samples are numbered from the largest perturbed value.
    ``inclusion``: the probability that the segmentation is among the k, given the rest; 1 where there are no more.
    ``decoded`` adds a column of that name: the text that decoding the ids gives.

    Defined cases: a null or empty text has one segmentation, without pieces; a text with fewer segmentations than k
    gives those; the noise comes from ``seed`` and the row's id, or its text where the id is null, so rows that share
    both get equal results; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    keyed = rows.withColumn("key", F.xxhash64(F.lit(seed), F.coalesce(F.col("id"), F.xxhash64("text"))))
    out = keyed.mapInArrow(_encode(path, k, alpha, decoded), _DDL + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode(ids: Column, path: str) -> Column:
    """The text of piece ids (bytes as above).

    Defined cases: null gives null, no bytes an empty text; bytes that aren't UTF-8 become U+FFFD; a U+2581 of the
    encoded text comes back as a space.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(vocabulary(path, 1.0))
        for s in batches:
            yield s.map(lambda x: None if x is None else decoder(x))

    return run(ids)
