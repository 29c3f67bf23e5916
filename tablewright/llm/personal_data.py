"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from spans that the patterns label in a bounded sample. It reads
overlapping windows of the texts; what the windows say is reconciled over the whole text, and
spans that no pattern covers are added.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import fresh_name, map_texts, texts_of

# The kinds in their order and the patterns that define them.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")          # no personal data without one of these

WIDTH, STRIDE = 96, 48                # a window and the way to the next; spans of 48 fit into one whole
EDGE = 4                              # a span so near to a cut edge is left to the next window
SURE = 0.9                            # mean probability of an added span's tags
SHORTEST = 6                          # characters of an added span
DOCUMENTS, WINDOWS = 20_000, 2_400    # bounds of the training sample
HIDDEN, BATCH, STEPS, RATE = 16, 32, 500, 0.02


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns: leftmost, not overlapping within a kind; matches that
    fail a kind's test are dropped."""
    if not SIGN.search(text):
        return []
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1) if at >= done else None
        if domain:
            low = at
            while low > done and text[low - 1] in LOCAL:
                low -= 1
            if low < at:
                done = domain.end()
                found.append((low, done, 0))
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


# Character classes the network sees: letters, one class for digits, some signs, and the rest.
SIGNS = " .@+-()_%/:,;\n"
LETTER, DIGIT, FIRST_SIGN = 26, 27, 28
OTHER, PAD = FIRST_SIGN + len(SIGNS), FIRST_SIGN + len(SIGNS) + 1
CLASSES = PAD + 1
TAGS = 1 + 2 * len(KINDS)             # outside; begin and inside of each kind


def _class_table() -> np.ndarray:
    out = np.full(1 << 16, OTHER, np.uint8)
    for c in range(0x250):
        ch = chr(c).lower()
        if len(ch) == 1 and "a" <= ch <= "z":
            out[c] = ord(ch) - 97
        elif chr(c).isalpha():
            out[c] = LETTER
    out[48:58] = DIGIT
    for i, ch in enumerate(SIGNS):
        out[ord(ch)] = FIRST_SIGN + i
    return out


CLASS_OF = _class_table()


def classes_of(text: str) -> np.ndarray:
    return CLASS_OF[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]


def window_starts(classes: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit or an at sign; other windows cannot hold a span."""
    signs = np.flatnonzero((classes == DIGIT) | (classes == FIRST_SIGN + SIGNS.index("@")))
    blocks = np.unique(signs // STRIDE)
    return np.unique(np.concatenate([blocks, np.maximum(blocks - 1, 0)])) * STRIDE


def _cut(classes: np.ndarray, start: int) -> np.ndarray:
    out = np.full(WIDTH, PAD, np.uint8)
    part = classes[start:start + WIDTH]
    out[:len(part)] = part
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Weights of the two LSTM directions (stacked), the emission layer and the CRF transitions."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 4):
        rng = np.random.default_rng(seed)
        h = hidden
        self.w = {
            "x": rng.normal(0, 0.3, (2, CLASSES, 4 * h)), "h": rng.normal(0, 0.3, (2, h, 4 * h)),
            "e": rng.normal(0, 0.3, (2 * h, TAGS)), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)),
        }
        self.w["x"][:, :, h:2 * h] += 1                           # forget gates start open
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.closed = np.zeros((TAGS, TAGS), np.float32)          # moves that no tagging makes
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.closed[:, inside] = -1e4
            self.closed[[inside - 1, inside], inside] = 0
        self.opening = np.where((np.arange(TAGS) > 0) & (np.arange(TAGS) % 2 == 0), np.float32(-1e4), np.float32(0))

    def _states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of both directions side by side, (steps, windows, 2 * hidden)."""
        wx, wh = self.w["x"], self.w["h"]
        h, n = wh.shape[1], len(x)
        given = np.stack([wx[0][x], wx[1][x[::-1]]], 1)
        state = np.zeros((2, x.shape[1], h), np.float32)
        cell = np.zeros_like(state)
        out = np.empty((n, 2, x.shape[1], h), np.float32)
        for t in range(n):
            g = given[t] + state @ wh
            gates, fresh = _sigmoid(g[:, :, :3 * h]), np.tanh(g[:, :, 3 * h:])
            old, was = cell, state
            cell = gates[:, :, h:2 * h] * old + gates[:, :, :h] * fresh
            bent = np.tanh(cell)
            state = gates[:, :, 2 * h:] * bent
            out[t] = state
            if keep is not None:
                keep.append((gates, fresh, old, bent, was))
        return np.concatenate([out[:, 0], out[::-1, 1]], 2)

    def decode(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags by Viterbi and their probabilities by the emissions, (windows, steps)."""
        e = self._states(windows.T) @ self.w["e"] + self.w["c"]
        moves = self.w["t"] + self.closed
        score, back = e[0] + self.opening, []
        for t in range(1, len(e)):
            ways = score[:, :, None] + moves
            back.append(ways.argmax(1))
            score = ways.max(1) + e[t]
        tags = np.empty((len(e), len(windows)), np.int64)
        tags[-1] = score.argmax(1)
        rows = np.arange(len(windows))
        for t in range(len(e) - 2, -1, -1):
            tags[t] = back[t][rows, tags[t + 1]]
        p = np.exp(e - e.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        return tags.T, np.take_along_axis(p, tags[:, :, None], 2)[:, :, 0].T

    def loss(self, windows: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood a window, and its gradients."""
        x, y = windows.T, tags.T
        n, m = x.shape
        h = self.w["h"].shape[1]
        kept: list = []
        states = self._states(x, kept)
        e = states @ self.w["e"] + self.w["c"]

        top = e.max(2, keepdims=True)
        likely, moves = np.exp(e - top), np.exp(self.w["t"] + self.closed)
        ahead, behind, scale = np.empty_like(e), np.ones_like(e), np.empty((n, m, 1), np.float32)
        for t in range(n):
            ahead[t] = likely[t] * (ahead[t - 1] @ moves if t else np.exp(self.opening))
            scale[t] = ahead[t].sum(1, keepdims=True)
            ahead[t] /= scale[t]
        for t in range(n - 2, -1, -1):
            behind[t] = (likely[t + 1] * behind[t + 1]) @ moves.T / scale[t + 1]
        total = np.log(scale).sum() + top.sum()
        at, rows = np.arange(n)[:, None], np.arange(m)[None, :]
        gold = e[at, rows, y].sum() + (self.w["t"] + self.closed)[y[:-1], y[1:]].sum()

        de = ahead * behind
        de[at, rows, y] -= 1
        de /= m
        dt = moves * np.tensordot(ahead[:-1], likely[1:] * behind[1:] / scale[1:], ((0, 1), (0, 1)))
        np.subtract.at(dt, (y[:-1], y[1:]), 1)
        grad = {"t": dt / m, "e": np.tensordot(states, de, ((0, 1), (0, 1))), "c": de.sum((0, 1))}
        whole = de @ self.w["e"].T
        given = np.stack([whole[:, :, :h], whole[::-1, :, h:]], 1)
        dgates = np.empty((n, 2, m, 4 * h), np.float32)
        dstate, dcell = np.zeros((2, m, h), np.float32), np.zeros((2, m, h), np.float32)
        wh = self.w["h"].transpose(0, 2, 1)
        for t in range(n - 1, -1, -1):
            gates, fresh, old, bent, _ = kept[t]
            i, f, o = gates[:, :, :h], gates[:, :, h:2 * h], gates[:, :, 2 * h:]
            dh = given[t] + dstate
            dc = dcell + dh * o * (1 - bent * bent)
            g = dgates[t]
            g[:, :, :h], g[:, :, h:2 * h], g[:, :, 2 * h:3 * h] = dc * fresh, dc * old, dh * bent
            g[:, :, :3 * h] *= gates * (1 - gates)
            g[:, :, 3 * h:] = dc * i * (1 - fresh * fresh)
            dstate, dcell = g @ wh, dc * f
        was = np.stack([k[4] for k in kept])
        grad["h"] = np.stack([np.tensordot(was[:, d], dgates[:, d], ((0, 1), (0, 1))) for d in range(2)])
        hot = np.eye(CLASSES, dtype=np.float32)
        grad["x"] = np.stack([np.tensordot(hot[x[::1 - 2 * d]], dgates[:, d], ((0, 1), (0, 1))) for d in range(2)])
        return float((total - gold) / m), grad

    def train(self, windows: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE) -> list[float]:
        """Adam over seeded batches; returns the loss of every step."""
        rng, losses = np.random.default_rng(4), []
        first, second = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}
        for s in range(1, steps + 1):
            pick = rng.integers(0, len(windows), batch)
            loss, grad = self.loss(windows[pick], tags[pick])
            losses.append(loss)
            pace = rate * (1 - 0.95 * s / steps)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                step = (first[k] / (1 - 0.9 ** s)) / (np.sqrt(second[k] / (1 - 0.99 ** s)) + 1e-8)
                self.w[k] = (self.w[k] - pace * step).astype(np.float32)
        return losses


def _tags(start: int, size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of a window; of overlapping spans the first wins."""
    out = np.zeros(WIDTH, np.int64)
    for low, high, kind in spans:
        a, b = max(low - start, 0), min(high - start, size)
        if a < b and not out[a:b].any():
            out[a:b] = 2 + 2 * kind
            out[a] = 1 + 2 * kind
    return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, low = [], -1
    for i, t in enumerate([*tags.tolist(), 0]):
        if low >= 0 and (t == 0 or t % 2 == 1):
            out.append((low, i, kind))
            low = -1
        if t and t % 2 == 1:
            low, kind = i, (t - 1) // 2
    return out


def reconcile(candidates: list[tuple[float, int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the spans that all windows of a text propose, those that fit together: the surest first, ties to
    the longer and then the earlier; none may touch a base span."""
    taken = sorted((low, high) for low, high, _ in base)
    out = []
    for sure, low, high, kind in sorted(set(candidates), key=lambda c: (-c[0], c[1] - c[2], c[1], c[3])):
        if all(high <= a or b <= low for a, b in taken):
            taken.append((low, high))
            out.append((low, high, kind))
    return out


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """What the network adds to the base spans of each text."""
    cuts, owner, classes = [], [], {}
    for i, t in enumerate(texts):
        if SIGN.search(t):
            classes[i] = classes_of(t)
            for s in window_starts(classes[i]).tolist():
                cuts.append((i, s))
    found: dict[int, list] = {}
    for k in range(0, len(cuts), 1024):
        part = cuts[k:k + 1024]
        tags, sure = model.decode(np.stack([_cut(classes[i], s) for i, s in part]))
        for row in np.flatnonzero(tags.any(1)).tolist():
            i, start = part[row]
            size = len(classes[i])
            for low, high, kind in spans_of(tags[row]):
                p = float(sure[row, low:high].mean())
                a, b = start + low, min(start + high, size)
                cut = (start > 0 and low < EDGE) or (start + WIDTH < size and high > WIDTH - EDGE)
                if not cut and p >= SURE and b - a >= SHORTEST and SIGN.search(texts[i], a, b):
                    found.setdefault(i, []).append((round(p, 6), a, b, kind))
    return [reconcile(found[i], bases[i]) if i in found else [] for i in range(len(texts))]


def fit_tagger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Tagger | None:
    """Train on at most WINDOWS windows, cut from about DOCUMENTS documents chosen by a hash of the id and
    labelled by the patterns (64 windows a document at most); None if no window holds anything. The driver gets windows, never documents."""
    rows = texts_of(docs, text, doc_id)
    place = F.pmod(F.xxhash64(F.lit(4), F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = min(1.0, DOCUMENTS / max(docs.count(), 1))

    def windows(data, offsets, part):
        out = []
        for t in part.column(1).to_pylist():
            classes, spans = classes_of(t), pattern_spans(t)
            own = []
            for s in window_starts(classes).tolist()[:64]:
                cut = _cut(classes, s)
                tags = _tags(s, WIDTH, [x for x in spans if x[1] > s and x[0] < s + WIDTH])
                own.append(cut.tobytes() + tags.astype(np.uint8).tobytes())
            out.append(own)
        return [pa.array(out, pa.list_(pa.binary()))]

    cut = map_texts(rows.where((place < share) & F.col("text").rlike("[0-9@]")), windows, [T.StructField("cuts", T.ArrayType(T.BinaryType()))], keep=["doc_id"])
    kept = cut.select(F.explode("cuts").alias("w")).distinct().withColumn("h", F.xxhash64("w")).orderBy("h", "w").limit(WINDOWS).collect()
    if not kept:
        return None
    both = np.stack([np.frombuffer(bytes(r["w"]), np.uint8) for r in kept])
    model = Tagger()
    model.train(both[:, :WIDTH], both[:, WIDTH:].astype(np.int64))
    return model


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.IntegerType())])


def mark_spans(docs: DataFrame, model: Tagger | None, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str, str]:
    """The ``keep`` columns with an array of base spans and one of all spans, and the names of these two."""
    keep = docs.columns if keep is None else keep
    base = fresh_name(keep, "__base")
    whole = fresh_name([*keep, base], "__spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))

    def work(data, offsets, rows):
        texts = [t or "" for t in rows.column(rows.schema.get_field_index(text)).to_pylist()]
        bases = [pattern_spans(t) for t in texts]
        more = added_spans(texts, bases, shared.value) if shared.value else [[]] * len(texts)
        every = [sorted(b + m, key=lambda s: (s[0], s[2])) for b, m in zip(bases, more)]
        return [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in col], kind) for col in (bases, every)]

    fields = [T.StructField(base, T.ArrayType(SPAN)), T.StructField(whole, T.ArrayType(SPAN))]
    return map_texts(docs, work, fields, text, keep), base, whole


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, line), ",")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Base spans follow fixed
    patterns; the network adds spans that overlap none of them and hold a digit or an at sign. Null and
    empty texts have no spans; long texts are read whole, window by window; repeated rows are treated one
    by one; without any base span in the sample nothing is added; an empty table gives no rows.
    """
    rows = texts_of(docs, text, doc_id)
    found, base, whole = mark_spans(rows, fit_tagger(rows), keep=["doc_id"])
    kinds = F.transform(base, lambda s: s["kind"])
    count = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(whole).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, such as ``[EMAIL]``; overlapping spans become
    one, named by the first. Null stays null; the other columns stay as they are."""
    model = fit_tagger(docs, doc_id, text)
    marked, _, whole = mark_spans(docs, model, text)
    name = fresh_name(marked.columns, "__clean")

    def work(data, offsets, rows):
        out = []
        for t, spans in zip(rows.column(rows.schema.get_field_index(text)).to_pylist(), rows.column(rows.schema.get_field_index(whole)).to_pylist()):
            if t is not None and spans:
                parts, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        parts += [t[at:s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                    at = max(at, s["end"])
                t = "".join(parts) + t[at:]
            out.append(t)
        return [pa.array(out, pa.string())]

    clean = map_texts(marked, work, [T.StructField(name, T.StringType())], text)
    return clean.select(*[F.col(name).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
