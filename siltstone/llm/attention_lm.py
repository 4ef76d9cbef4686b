"""Language-model scores: a small causal self-attention model in numpy over the subwords of a public tokenizer.

Subwords are reduced to CODES: the commonest ones of the corpus, an end, and "other",
which is spread over all other subwords by their counts. The model is a table of the
next code given the last one, counted over all training documents, corrected by a causal
self-attention head that is trained on all their windows: one task starts it on about
WARM_BYTES of text, then every task goes on with the documents it has, and the weights
are averaged by windows. The head weighs GROUPS of codes, so that a score
costs as much for many codes as for few: P(code) = P(group | window) P(code | group, last).
Windows overlap: WINDOW codes are seen, the last STRIDE scored, so that each code is
scored once with at least WINDOW - STRIDE codes of context (fewer only where a text begins).

The base score, a smoothed unigram of whole words, needs the exact count of every word
of all training documents. Words meet by their hash: each block of documents sends its
distinct words once, and gets back only the counts that differ from its own.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import FOLD_BYTES, bounded_batches, text_or_empty, written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Codes: 0 .. CODES - 3 common subwords, then OTHER and END; inputs have BOS and hashed places for other subwords besides.
CODES, HASHED, GROUPS = 2048, 255, 64
OTHER, END, BOS = CODES - 2, CODES - 1, CODES
INPUTS = CODES + 1 + HASHED
WINDOW, STRIDE, WIDTH = 48, 32, 16
#: UTF-8 bytes of the texts on which one task starts the attention, least steps of that, windows of a step there and later.
WARM_BYTES, STEPS, BATCH, LATER_BATCH = 4 << 20, 1_500, 64, 128
#: Windows that a task which goes on holds and shuffles.
HELD = 8_192
SMOOTH_WORD, SMOOTH_CODE = 0.1, 0.5
#: Logits aren't larger: their exponentials stay finite without a look for the largest.
MOST_LOGIT = 60
#: UTF-8 bytes of a block of documents, whose distinct words one task holds.
BLOCK_BYTES = 12 << 20
#: UTF-8 bytes of texts that are cut into subwords together, at least.
CUT_BYTES = 8 << 20


def vocabulary(path: str = TOKENIZER) -> bytes:
    """The tokenizer's file, read on the driver; its content travels with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encoding(content: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def folded(text: str | bytes) -> str:
    data = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return data.translate(FOLD_BYTES).decode("utf-8", "replace")


def held_out(doc_id: str, of: int = 10):
    """Whether the checksum of the id as text is divisible by ``of``: never learnt from. A null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == 0, F.lit(True))


class Tables:
    """Codes of subwords, the table of the next code, and the share of each subword among the others."""

    def __init__(self, counts: dict[int, int], n_subwords: int):
        total = np.zeros(n_subwords, np.float64)
        for i, c in counts.items():
            total[i] = c
        common = np.lexsort((np.arange(n_subwords), -total))[: CODES - 2]
        self.code = np.full(n_subwords, OTHER, np.int64)
        self.code[common] = np.arange(len(common))
        self.input = np.where(self.code == OTHER, BOS + 1 + np.arange(n_subwords) % HASHED, self.code)
        rest = self.code == OTHER
        self.code, self.input = self.code.astype(np.int32), self.input.astype(np.int32)
        self.other = np.where(rest, np.log((total + SMOOTH_CODE) / (total[rest].sum() + SMOOTH_CODE * rest.sum())), 0.0)
        self.next = np.full((INPUTS, CODES), -math.log(CODES), np.float32)
        self.group = np.arange(CODES) % GROUPS
        self._sum_groups()

    def learn_next(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Counts of input * CODES + code. Interpolated with the counts of codes alone; like codes get a group."""
        n = np.bincount(keys, weights=counts, minlength=INPUTS * CODES).reshape(INPUTS, CODES)
        alone = n.sum(axis=0) + SMOOTH_CODE
        alone /= alone.sum()
        seen = n.sum(axis=1, keepdims=True)
        # the more kinds of codes have followed, the more a new one may (Witten and Bell)
        weight = (n > 0).sum(axis=1, keepdims=True) + 1.0
        self.next = np.log((n + weight * alone) / (seen + weight)).astype(np.float32)
        self.group = _groups(n)
        self._sum_groups()

    def _sum_groups(self) -> None:
        """The logarithm of the table's sums over the groups of codes."""
        member = np.zeros((CODES, GROUPS), np.float32)
        member[np.arange(CODES), self.group] = 1
        self.next_group = np.log(np.exp(self.next) @ member + np.float32(1e-30))

    def sequence(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Inputs (BOS first), codes (END last) and the log probability of the others' choice, of one text."""
        inputs, codes = np.empty(len(ids) + 1, np.int32), np.empty(len(ids) + 1, np.int32)
        inputs[0], codes[-1] = BOS, END
        np.take(self.input, ids, out=inputs[1:])
        np.take(self.code, ids, out=codes[:-1])
        return inputs, codes, float(self.other[ids].sum())


def _groups(n: np.ndarray, rounds: int = 12) -> np.ndarray:
    """GROUPS groups of codes with like neighbours: k-means over the shares of the 64 commonest codes before and after."""
    top = np.lexsort((np.arange(CODES), -n.sum(axis=0)))[:64]
    before, after = n[top].T, np.zeros((CODES, 64))
    after[: min(CODES, INPUTS)] = n[:CODES][:, top]
    shares = [np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1)) for x in (before, after)]
    x = np.hstack(shares)
    centre = x[np.lexsort((np.arange(CODES), -n.sum(axis=0)))[:: CODES // GROUPS][:GROUPS]].copy()
    for _ in range(rounds):
        group = ((centre**2).sum(axis=1)[None, :] - 2 * x @ centre.T).argmin(axis=1)
        size = np.bincount(group, minlength=GROUPS)
        sums = np.zeros_like(centre)
        np.add.at(sums, group, x)
        centre = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centre)
    return group


def windows(inputs: np.ndarray) -> np.ndarray:
    """(n, WINDOW) indices into the inputs of one text, -1 where there is none; the last STRIDE of each are scored."""
    starts = np.arange(0, len(inputs), STRIDE)
    at = starts[:, None] + np.arange(STRIDE - WINDOW, STRIDE)[None, :]
    return np.where((at < 0) | (at >= len(inputs)), -1, at)


def _laid(made: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts' (inputs, codes): inputs (n, WINDOW), BOS where there are none, codes (n, STRIDE), -1 where there are none, and whether a window is its text's first."""
    counts = [-(-len(c) // STRIDE) for _, c in made]
    ends = np.concatenate([[0], np.cumsum(counts)])
    seen = np.full((ends[-1], WINDOW), BOS, np.int32)
    codes = np.full((ends[-1], STRIDE), -1, np.int32)
    first = np.zeros(ends[-1], bool)
    first[ends[:-1]] = True
    for (inputs, wanted), a, n in zip(made, ends[:-1].tolist(), counts, strict=True):
        padded = np.full(WINDOW - STRIDE + n * STRIDE, BOS, np.int32)
        padded[WINDOW - STRIDE : WINDOW - STRIDE + len(inputs)] = inputs
        seen[a : a + n] = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]
        codes[a : a + n].reshape(-1)[: len(wanted)] = wanted
    return seen, codes, first


def _mask() -> np.ndarray:
    query = np.arange(WINDOW - STRIDE, WINDOW)[:, None]
    return np.where(np.arange(WINDOW)[None, :] <= query, 0.0, -1e9).astype(np.float32)


_MASK = _mask()


class Scratch(dict):
    """Arrays that are written anew in every step: fresh ones would cost more than the sums in them."""

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        found = self.get(name)
        if found is None or found.shape != shape:
            found = self[name] = np.empty(shape, self.kind)
        return found

    def __init__(self, kind):
        super().__init__()
        self.kind = kind


class Attention:
    """One head over the window; its output is a correction of the logits of groups."""

    NAMES = ("e", "pos", "wq", "wk", "wv", "out")

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        small = lambda *shape: (draw.standard_normal(shape) * 0.3 / math.sqrt(WIDTH)).astype(np.float32)
        self.p = {"e": small(INPUTS, WIDTH) * 3, "pos": small(WINDOW, WIDTH), "wq": small(WIDTH, WIDTH) * 3, "wk": small(WIDTH, WIDTH) * 3, "wv": small(WIDTH, WIDTH) * 3, "out": small(WIDTH, GROUPS) * 0.1}
        self._room = Scratch(np.float32)

    def __getstate__(self):
        return self.__dict__ | {"_room": Scratch(np.float32)}

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """wq wk and wv out: queries meet the places as they are, and what they gather of them goes to the logits at once. Keys and values needn't be made."""
        p, kind = self.p, self.p["e"].dtype.type
        return p["wq"] @ p["wk"].T * kind(1 / math.sqrt(WIDTH)), p["wv"] @ p["out"]

    def forward(self, seen: np.ndarray, absent: np.ndarray, room: Scratch):
        """seen: (n, WINDOW) inputs; absent: where there are none, all or none of a row's first places. Attention output (n, STRIDE, WIDTH) and what backward needs."""
        p, n, late = self.p, len(seen), slice(WINDOW - STRIDE, WINDOW)
        x = np.take(p["e"], seen, axis=0, out=room("x", n, WINDOW, WIDTH), mode="clip")
        x += p["pos"]
        scored = room("scored", n, STRIDE, WIDTH)
        scored[:] = x[:, late]
        side = lambda name, a, w: np.matmul(a.reshape(-1, WIDTH), w, out=room(name, a.shape[0] * a.shape[1], WIDTH)).reshape(a.shape)
        q, k, v = side("q", scored, p["wq"] * room.kind(1 / math.sqrt(WIDTH))), side("k", x, p["wk"]), side("v", x, p["wv"])
        s = np.matmul(q, k.transpose(0, 2, 1), out=room("s", n, STRIDE, WINDOW))
        s += _mask()
        some = np.flatnonzero(absent.any(axis=1))
        if len(some):
            s[some] += np.where(absent[some], room.kind(-1e9), room.kind(0))[:, None, :]
        np.minimum(s, MOST_LOGIT, out=s)
        np.exp(s, out=s)
        s /= (s @ np.ones(WINDOW, room.kind))[:, :, None]
        return np.matmul(s, v, out=room("o", n, STRIDE, WIDTH)), (x, scored, q, k, v, s)

    def train(self, made: tuple[np.ndarray, ...], table: np.ndarray, steps: int, seed: int = 6) -> None:
        """Adam over shuffled batches: each window once, and again until there have been ``steps`` of them.

        made: seen, absent, last, codes: (n, STRIDE) inputs and groups to predict, -1 where there are none.
        """
        draw, n = np.random.default_rng(seed), len(made[0])
        step_by, each = self._adam(), -(-n // BATCH)
        total, step = each * max(1, -(-steps // each)), 0
        while step < total:
            order = draw.permutation(n)
            for a in range(0, n, BATCH):
                step += 1
                b = order[a : a + BATCH]
                step_by(self._gradients(*(x[b] for x in made), table), 0.01 * min(1.0, 2 * (1 - step / (total + 1))))

    def train_on(self, parts: Iterator[tuple[np.ndarray, ...]], table: np.ndarray, seed: int = 7) -> int:
        """Go on at a low rate, each window of each part once; the number of windows."""
        draw, step_by, windows_seen = np.random.default_rng(seed), self._adam(), 0
        for made in parts:
            order = draw.permutation(len(made[0]))
            for a in range(0, len(order), LATER_BATCH):
                b = order[a : a + LATER_BATCH]
                step_by(self._gradients(*(x[b] for x in made), table), 0.002)
            windows_seen += len(order)
        return windows_seen

    def _adam(self):
        m, r = ({n: np.zeros_like(w) for n, w in self.p.items()} for _ in range(2))
        step = 0

        def by(gradients: dict[str, np.ndarray], rate: float) -> None:
            nonlocal step
            step += 1
            for name, g in gradients.items():
                m[name] += 0.1 * (g - m[name])
                r[name] += 0.01 * (g * g - r[name])
                self.p[name] -= np.float32(rate) * (m[name] / (1 - 0.9**step)) / (np.sqrt(r[name] / (1 - 0.99**step)) + 1e-8)

        return by

    def _gradients(self, seen, absent, last, codes, table) -> dict[str, np.ndarray]:
        p = self.p
        room = self._room if self._room.kind == p["e"].dtype.type else Scratch(p["e"].dtype.type)
        n, groups = len(seen), p["out"].shape[1]
        o, (x, scored, q, k, v, s) = self.forward(seen, absent, room)
        rows = lambda a: a.reshape(-1, WIDTH)
        d = np.matmul(rows(o), p["out"], out=room("d", n * STRIDE, groups))
        d += np.take(table, last.reshape(-1), axis=0, out=room("table", n * STRIDE, groups), mode="clip") if table.dtype == d.dtype else table[last.reshape(-1)]
        np.minimum(d, MOST_LOGIT, out=d)
        np.exp(d, out=d)
        wanted = codes.reshape(-1)
        weight = (wanted >= 0) / room.kind(max(1, (wanted >= 0).sum()))
        d *= (weight / (d @ np.ones(groups, d.dtype))).astype(d.dtype)[:, None]
        real = np.flatnonzero(wanted >= 0)
        d.reshape(-1)[real * groups + wanted[real]] -= weight[real]
        do = np.matmul(d, p["out"].T, out=room("do", n * STRIDE, WIDTH)).reshape(o.shape)
        dv = np.matmul(s.transpose(0, 2, 1), do, out=room("dv", n, WINDOW, WIDTH))
        ds = np.matmul(do, v.transpose(0, 2, 1), out=room("ds", n, STRIDE, WINDOW))
        # the sum of ds * s over the keys is that of do * o over the width
        ds -= np.einsum("ij,ij->i", rows(do), rows(o)).reshape(n, STRIDE, 1)
        ds *= s
        dq = np.matmul(ds, k, out=room("dq", n, STRIDE, WIDTH))
        dq *= room.kind(1 / math.sqrt(WIDTH))
        dk = np.matmul(ds.transpose(0, 2, 1), q, out=room("dk", n, WINDOW, WIDTH))
        dx = np.matmul(rows(dk), p["wk"].T, out=room("dx", n * WINDOW, WIDTH))
        dx += np.matmul(rows(dv), p["wv"].T, out=room("more", n * WINDOW, WIDTH))
        placed = dx.reshape(x.shape)
        placed[:, WINDOW - STRIDE :] += np.matmul(rows(dq), p["wq"].T, out=room("own", n * STRIDE, WIDTH)).reshape(dq.shape)
        de = np.zeros_like(p["e"])
        order = np.argsort(seen.astype(np.uint16), axis=None, kind="stable")  # by radix
        told = seen.reshape(-1)[order]
        first = np.flatnonzero(np.concatenate([[True], told[1:] != told[:-1]]))
        de[told[first]] = np.add.reduceat(np.take(dx, order, axis=0, out=room("sorted", n * WINDOW, WIDTH), mode="clip"), first)
        return {"e": de, "pos": placed.sum(axis=0), "wq": rows(scored).T @ rows(dq), "wk": rows(x).T @ rows(dk), "wv": rows(x).T @ rows(dv), "out": rows(o).T @ d}


class Model:
    def __init__(self, tables: Tables, content: bytes):
        self.tables, self.attention, self.content = tables, Attention(), content
        self._encoding, self.n_windows = None, 0

    def __getstate__(self):
        return self.__dict__ | {"_encoding": None}

    def ids(self, text: str | bytes) -> np.ndarray:
        if self._encoding is None:
            self._encoding = encoding(self.content)
        return self._encoding.encode_to_numpy(folded(text), disallowed_special=())

    def parts(self, documents: Iterator[np.ndarray], held: float = math.inf) -> Iterator[tuple[np.ndarray, ...]]:
        """Windows of documents' ids, as Attention.train takes them: about ``held`` at a time."""
        group = np.append(self.tables.group, -1).astype(np.int16)  # the last one of code -1

        def laid(made: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
            seen, codes, first = _laid(made)
            absent = np.zeros((len(seen), WINDOW), bool)
            absent[first, : WINDOW - STRIDE] = True
            return seen, absent, seen[:, WINDOW - STRIDE :], group[codes]

        made, n = [], 0
        for ids in documents:
            made.append(self.tables.sequence(ids)[:2])
            n += -(-len(made[-1][0]) // STRIDE)
            if n >= held:
                yield laid(made)
                made, n = [], 0
        if made:
            yield laid(made)

    def scores(self, texts: list[str | bytes]) -> list[float]:
        """The natural logarithm of each text's probability."""
        return self.scores_of([self.ids(t) for t in texts])

    def scores_of(self, documents: list[np.ndarray], block: int = 48) -> list[float]:
        """The same for documents of subwords: windows of all of them in batches, without the training's bookkeeping."""
        made = [self.tables.sequence(ids) for ids in documents]
        if not made:
            return []
        table, group = self.tables.next, self.tables.group
        share = np.exp(self.tables.next_group)
        p, (a, b) = self.attention.p, self.attention.products()
        late = slice(WINDOW - STRIDE, WINDOW)
        q_of, q_at = p["e"] @ a, p["pos"][late] @ a
        # seen places: all before the query; in a text's first window none before the text. Later ones are never looked at
        before = np.where(np.arange(WINDOW) < WINDOW - STRIDE, np.float32(-1e9), np.float32(0))
        seen, codes, first = _laid([x[:2] for x in made])
        real, wanted = codes >= 0, np.maximum(codes, 0)
        hit = table[seen[:, late], wanted]
        place = np.arange(block * STRIDE) * GROUPS
        at = group[wanted].reshape(len(seen), -1)
        total = np.empty(codes.shape, np.float32)
        room, ones = self.attention._room, np.ones(WINDOW, np.float32)
        for i in range(0, len(seen), block):
            w = slice(i, i + block)
            last, n = seen[w, late], len(seen[w])
            x = np.take(p["e"], seen[w], axis=0, out=room("x", n, WINDOW, WIDTH), mode="clip")
            x += p["pos"]
            q = np.take(q_of, last, axis=0, out=room("query", n, STRIDE, WIDTH), mode="clip")
            q += q_at
            s = np.matmul(q, x.transpose(0, 2, 1), out=room("s", n, STRIDE, WINDOW))
            s += _MASK
            s[first[w]] += before
            np.exp(s, out=s)
            o = np.matmul(s, x, out=room("o", n, STRIDE, WIDTH))
            o /= (s.reshape(-1, WINDOW) @ ones).reshape(n, STRIDE, 1)
            more = np.matmul(o.reshape(-1, WIDTH), b, out=room("d", n * STRIDE, GROUPS))
            hit[w] += np.take(more.reshape(-1), place[: n * STRIDE] + at[w].reshape(-1)).reshape(n, STRIDE)
            np.exp(more, out=more)
            np.einsum("nc,nc->n", np.take(share, last.reshape(-1), axis=0, out=room("table", n * STRIDE, GROUPS), mode="clip"), more, out=total[w].reshape(-1))
        told = np.where(real, hit - np.log(total), np.float32(0)).sum(axis=1, dtype=np.float64)
        sums = np.add.reduceat(told, np.flatnonzero(first))
        return [float(s + x[2]) for s, x in zip(sums, made, strict=True)]


def _kind(n_subwords: int) -> np.dtype:
    """What a subword is written as: a text's subwords travel as bytes, which nothing on the way takes apart."""
    return np.dtype("<u2" if n_subwords <= 1 << 16 else "<u4")


class Subwords:
    """The tokenizer over many texts at once: what lies between spaces is cut once, however often it comes.

    No subword reaches from what isn't white space into white space, and a space before something else
    begins one. So texts may be cut there, and the parts are cut as they would be in their texts.
    """

    def __init__(self, content: bytes):
        self.tokens = encoding(content)
        self.kind = _kind(self.tokens.n_vocab)
        self.size = np.array([len(x) for x in subword_bytes(self.tokens, range(self.tokens.n_vocab))])

    def one(self, text: str) -> np.ndarray:
        return self.tokens.encode_to_numpy(text, disallowed_special=())

    def __call__(self, texts: list[str]) -> pa.Array:
        """Of each folded text its subwords as bytes."""
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        number, ends = coded.indices.to_numpy(), lists.offsets.to_numpy()
        parts = coded.dictionary
        # white space after a space: such a space begins no subword of its own
        odd = pc.or_(pc.equal(pc.binary_length(parts), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(parts, 0, 1))).to_numpy(zero_copy_only=False)
        spaced = pc.if_else(pa.array(odd), "", pc.binary_join_element_wise("", parts, " "))
        size = pc.binary_length(spaced).to_numpy()
        found = self.one(spaced.buffers()[2].to_pybytes()[: size.sum()].decode() if size.any() else "")
        cut = np.searchsorted(np.cumsum(self.size[found]), np.cumsum(size), side="right")
        begin, count = np.concatenate([[0], cut])[number], np.diff(cut, prepend=0)[number]
        whole = set()
        if odd.any():
            strange = odd[number]
            strange[ends[:-1]] = False
            whole = set(np.unique(np.searchsorted(ends, np.flatnonzero(strange), side="right") - 1).tolist())
        # a text's first part has no space before it
        first = [self.one(texts[i] if i in whole else w) for i, w in enumerate(parts.take(coded.indices.take(pa.array(ends[:-1]))).to_pylist())]
        for i in whole:
            count[ends[i] : ends[i + 1]] = 0
        count[ends[:-1]] = [len(x) for x in first]
        begin[ends[:-1]] = len(found) + np.cumsum(count[ends[:-1]]) - count[ends[:-1]]
        found = np.concatenate([found, *first]).astype(self.kind)
        till = np.cumsum(count)
        flat = found[np.repeat(begin - till + count, count) + np.arange(till[-1] if len(till) else 0)]
        offsets = np.concatenate([[0], till[ends[1:] - 1]]) * self.kind.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def _together(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """Batches, as many at a time as have ``most`` bytes of a column, the last of them included."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def tokenized(docs: DataFrame, content: bytes) -> DataFrame:
    """docs (text and other columns) with mark, the text's hash, and ids, its subwords as bytes, in place of the text."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(content)
        for rows in _together(batches, "text", CUT_BYTES):
            if not rows.num_rows:
                continue
            ids = subwords([folded(t) for t in rows.column("text").to_pylist()])
            yield from pa.table([*(rows.column(c) for c in [*kept, "mark"]), ids], [*kept, "mark", "ids"]).to_batches()

    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "mark long, ids binary"])
    return docs.withColumn("mark", F.xxhash64("text")).mapInArrow(run, ddl)


def _documents(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    for batch in batches:
        yield from (np.frombuffer(x, kind) for x in batch.column("ids").to_pylist())


def fit(train: DataFrame, text: str = "text", path: str = TOKENIZER) -> Model:
    """Learn from all rows of train, each as often as it comes. Without any, all subwords are equally likely."""
    content = vocabulary(path)
    # rows are told apart by all their columns, so that copies of a text under other ids part
    named = train.select(F.xxhash64(*train.columns).alias("at"), text_or_empty(train, text).alias("text"))
    return learn(written(tokenized(named, content), "subwords"), content)


def learn(sample: DataFrame, content: bytes) -> Model:
    """A model of all rows of the written table (at, ids), as tokenized makes it."""
    n_subwords = encoding(content).n_vocab
    kind = _kind(n_subwords)

    def subwords(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_subwords, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=n_subwords)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some), pa.array(n[some])], ["k", "n"])

    def summed(run) -> tuple[np.ndarray, np.ndarray]:
        found = sample.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        return found.column("k").to_numpy(), found.column("n").to_numpy()

    seen, times = summed(subwords)  # one row a subword at most
    tables = Tables(dict(zip(seen.tolist(), times.tolist(), strict=True)), n_subwords)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(INPUTS * CODES, np.int64)
        for ids in _documents(batches, kind):
            inputs, codes, _ = tables.sequence(ids)
            np.add.at(n, inputs.astype(np.int64) * CODES + codes, 1)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some), pa.array(n[some])], ["k", "n"])

    keys, counts = summed(pairs)  # one row a pair of codes at most
    tables.learn_next(keys, counts.astype(np.float64))
    model = Model(tables, content)
    size = sum(n * len(b) for n, b in zip(times.tolist(), subword_bytes(encoding(content), seen.tolist()), strict=True))
    model.n_windows = _train(model, sample, max(1, -(-size // WARM_BYTES)), STEPS)
    return model


def subword_bytes(tokens: tiktoken.Encoding, ids: Iterable[int]) -> list[bytes]:
    return [tokens.decode_single_token_bytes(i) for i in ids]


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of the partition's (n, weights), by n."""
    total, n = None, 0
    for batch in batches:
        for k, w in zip(batch.column("n").to_pylist(), batch.column("weights").to_pylist(), strict=True):
            part = np.frombuffer(w, np.float32).astype(np.float64) * k
            total = part if total is None else total + part
            n += k
    if n:
        yield pa.record_batch([pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()])], ["n", "weights"])


def averaged(rows: DataFrame, partitions: int) -> tuple[int, np.ndarray] | None:
    """The sum of n and the mean of weights by n over (n, weights), a row a partition at most; None without rows. The driver gets a cube root of them."""
    for k in (round(partitions ** (2 / 3)), round(partitions ** (1 / 3))):
        rows = rows.repartition(max(1, k)).mapInArrow(_mean, "n long, weights binary")
    found = rows.toArrow()
    told = list(_mean(iter(found.to_batches())))
    return (told[0].column("n")[0].as_py(), np.frombuffer(told[0].column("weights")[0].as_py(), np.float32).copy()) if told else None


def _train(model: Model, sample: DataFrame, shares: int, steps: int) -> int:
    """Train the attention on all rows of (at, ids): first on one of ``shares``, then on the others from there. The number of windows."""
    spark = sample.sparkSession
    share = F.pmod("at", F.lit(shares))

    def trained(rows: DataFrame, run) -> int:
        sent = spark.sparkContext.broadcast(model)

        def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = sent.value
            net = Attention()
            net.p = {n: w.copy() for n, w in mine.attention.p.items()}
            n = run(mine, net, _documents(batches, _kind(len(mine.tables.code))))
            if n:
                yield pa.record_batch([pa.array([n]), pa.array([b"".join(net.p[x].tobytes() for x in net.NAMES)])], ["n", "weights"])

        found = averaged(rows.mapInArrow(weights, "n long, weights binary"), rows.rdd.getNumPartitions())
        if found is None:
            return 0
        at = 0
        for name in Attention.NAMES:
            w = model.attention.p[name]
            model.attention.p[name] = found[1][at : at + w.size].reshape(w.shape)
            at += w.size
        sent.unpersist()
        return found[0]

    def start(mine: Model, net: Attention, documents: Iterator[np.ndarray]) -> int:
        n = 0
        for made in mine.parts(documents):
            net.train(made, mine.tables.next_group, steps)
            n = len(made[0])
        return n

    def go_on(mine: Model, net: Attention, documents: Iterator[np.ndarray]) -> int:
        return net.train_on(mine.parts(documents, HELD), mine.tables.next_group)

    n = trained(sample.where(share == 0).repartition(1).sortWithinPartitions("at"), start)
    return n + (trained(sample.where(share != 0), go_on) if shares > 1 else 0)


#: The end of a text, as a word: no word is empty.
_END = b""


def words_of(text: bytes) -> list[bytes]:
    """Runs without space or control white space, A-Z lower-cased, then the end."""
    return [*text.translate(FOLD_BYTES).split(), _END]


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _bytes_of(texts: pa.StringArray) -> list[bytes]:
    """Those of texts without nulls, in a third of to_pylist's time."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).tolist()
    data = texts.buffers()[2].to_pybytes() if ends[-1] else b""
    return [data[a:b] for a, b in pairwise(ends)]


class Words:
    """words_of many texts at once: the distinct ones, of which the end is the last, and each text's as numbers (without its end)."""

    def __init__(self, texts: pa.Array):
        # the bytes aren't looked at as UTF-8 here: all functions are those of ASCII
        bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string(), safe=False)))
        lists = pc.ascii_split_whitespace(bare)
        coded = lists.flatten().dictionary_encode()
        self.distinct: list[bytes] = [*_bytes_of(coded.dictionary), _END]
        number, ends = coded.indices.to_numpy(), lists.offsets.to_numpy()
        empty = pc.binary_length(bare).to_numpy() == 0  # such a text is split into one empty word
        size = np.diff(ends) - empty
        if empty.any():
            number = number[np.repeat(~empty, np.diff(ends))]
        self.number, self.size = number, size
        self.ends = np.cumsum(size)

    def sums(self, value: np.ndarray) -> np.ndarray:
        """Of each text the sum of its words' values, its end included."""
        out = np.full(len(self.size), value[-1], value.dtype)
        some = np.flatnonzero(self.size)
        if len(some):
            out[some] += np.add.reduceat(value[self.number], (self.ends - self.size)[some])
        return out

    def counts(self, learn: np.ndarray) -> np.ndarray:
        """How often each distinct word comes in the texts that are learnt from."""
        n = np.bincount(self.number[np.repeat(learn, self.size)], minlength=len(self.distinct))
        n[-1] = learn.sum()
        return n


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, block, n) over rows sorted by block: each block's distinct words with their counts in its training documents."""

    def tell(block: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        found = Words(rows.column("text").chunk(0))
        counts = found.counts(rows.column("learn").to_numpy() > 0)
        # an empty text's word is the end, which is counted as such
        own = [i for i, w in enumerate(found.distinct[:-1]) if w] + [len(found.distinct) - 1]
        for a in range(0, len(own), 100_000):
            part = own[a : a + 100_000]
            h = hashed([found.distinct[i] for i in part])
            yield pa.record_batch([pa.array(h), pa.array(np.full(len(h), block, np.int64)), pa.array(counts[part])], ["word", "block", "n"])

    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("block").to_numpy()
        cuts = (np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if held and blocks[a] != now:
                yield from tell(now, held)
                held = []
            now = int(blocks[a])
            held.append(batch.slice(a, b - a).select(["text", "learn"]))
    if held:
        yield from tell(now, held)


#: The block of a row that sums up several words: how many occur, and how often.
SUMMED = -1


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (word, block, n) sorted by word: (block, word, total) of those whose total isn't n, and rows of SUMMED.

    Only the last word is held, a row a block at most.
    """

    def tell(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        word, block, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        total = np.add.reduceat(n, starts)
        each = np.repeat(total, np.diff(np.append(starts, len(word))))
        some = np.flatnonzero(each != n)
        columns = (np.append(block[some], SUMMED), np.append(word[some], (total > 0).sum()), np.append(each[some], total.sum()))
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["block", "word", "total"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        word, block, n = (batch.column(c).to_numpy() for c in ("word", "block", "n"))
        cut = int(np.searchsorted(word, word[-1]))  # the last word may go on
        if held and (cut or word[0] != held[-1][0][-1]):
            yield tell([*held, (word[:cut], block[:cut], n[:cut])])
            held = []
        elif cut:
            yield tell([(word[:cut], block[:cut], n[:cut])])
        held.append((word[cut:], block[cut:], n[cut:]))
    if held:
        yield tell(held)


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    A null text is empty: its one token is the end. Rows with a null id are scored, not learnt
    from. Repeated rows count and score as often as they come. Scores are log10 probabilities;
    without any training document the base score is null. Texts are told apart, within one id,
    by a hash of 64 bits.
    """
    bounded_batches(docs.sparkSession)
    content = vocabulary(path)
    named = docs.select(docs[doc_id].alias("doc_id"), text_or_empty(docs, text).alias("text")).withColumn("held_out", held_out("doc_id"))
    subwords = written(tokenized(named, content), "subwords")
    model = learn(subwords.where(~F.col("held_out")).select(F.xxhash64("doc_id", "mark").alias("at"), "ids"), content)
    scored = _scored(subwords, model)
    base = _base_scores(named.withColumn("mark", F.xxhash64("text"))).alias("b")
    both = base.join(scored.alias("s"), F.col("b.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("b.mark") == F.col("s.mark")))
    return both.select("b.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _scored(subwords: DataFrame, model: Model) -> DataFrame:
    """(doc_id, mark, score) of the distinct rows of (doc_id, mark, ids)."""
    sent = subwords.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        kind = _kind(len(model.tables.code))
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                scores = [x / math.log(10) for x in model.scores_of(list(_documents([part], kind)))]
                yield pa.record_batch([part.column("doc_id"), part.column("mark"), pa.array(scores, pa.float64())], ["doc_id", "mark", "score"])

    of = subwords.schema["doc_id"].dataType.simpleString()
    return subwords.select("doc_id", "mark", "ids").mapInArrow(run, f"doc_id {of}, mark long, score double").groupBy("doc_id", "mark").agg(F.min("score").alias("score"))


def _base_scores(named: DataFrame) -> DataFrame:
    """(doc_id, mark, held_out, n_tokens, n_known, train_tokens, base_score) of rows of (doc_id, text, held_out, mark)."""
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    placed = named.withColumn("block", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(blocks))).withColumn("learn", (~F.col("held_out")).cast("int"))
    dealt = placed.withColumn("text", F.col("text").cast("binary")).repartition("block")
    words = dealt.sortWithinPartitions("block").mapInArrow(_block_words, "word long, block long, n long")  # all columns: one exchange of the texts serves both uses
    # opaque to the optimizer, so that both uses of it share one exchange
    told = words.repartition("word").sortWithinPartitions("word").mapInArrow(_totals, "block long, word long, total long")
    other = told.where(F.col("block") != SUMMED)

    def score(docs_part: pa.Table, counts: pa.Table) -> pa.Table:
        rows = docs_part.combine_chunks()
        found = Words(rows.column("text").chunk(0))
        total = found.counts(rows.column("learn").to_numpy() > 0)
        # what the other blocks have besides: sorted by hash, looked up by hash
        other, count = (np.array(counts.column(c).to_numpy()) for c in ("word", "total"))
        order = np.argsort(other)
        other, count = other[order], count[order]
        h = hashed(found.distinct)
        at = np.minimum(np.searchsorted(other, h), max(0, len(other) - 1))
        met = other[at] == h if len(other) else np.zeros(len(h), bool)
        total[met] = count[at[met]]
        return pa.table({
            **{c: rows.column(c) for c in ("doc_id", "mark", "held_out")}, "n_tokens": pa.array(found.size + 1, pa.int64()),
            "n_known": pa.array(found.sums((total > 0).astype(np.int64))), "log_sum": pa.array(found.sums(np.log10(total + SMOOTH_WORD))),
        })

    kind = named.schema["doc_id"].dataType.simpleString()
    summed = dealt.groupBy("block").cogroup(other.groupBy("block")).applyInArrow(score, f"doc_id {kind}, mark long, held_out boolean, n_tokens long, n_known long, log_sum double")
    whole = told.where(F.col("block") == SUMMED).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("word"), F.lit(0)).alias("distinct"))
    scale = F.log10(F.col("train_tokens") + SMOOTH_WORD * (F.col("distinct") + 1))
    base = F.when(F.col("train_tokens") > 0, F.col("log_sum") - F.col("n_tokens") * scale)
    return summed.crossJoin(F.broadcast(whole)).select("doc_id", "mark", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"))


def is_held_out(doc_id: int) -> bool:
    """held_out for one id, in Python."""
    return zlib.crc32(str(doc_id).encode()) % 10 == 0
