"""Gated recurrent language model over token codes, in numpy.

A code below ``HEAD`` is a frequent word, the others are classes of rarer
words.  The output is factored: one softmax over the classes (``HEAD / WIDTH``
groups of frequent words, then the classes of rarer words) and, for a
frequent word, one over the ``WIDTH`` words of its group.  Texts run in lanes
of equal work, one text after the other in a lane; the state is cleared where
a text begins and carried over all window borders inside it."""

from __future__ import annotations

import heapq

import numpy as np

HEAD, WIDTH = 2048, 64
GROUPS = HEAD // WIDTH
HIDDEN = 32
SCORE_LANES, SCORE_WINDOW = 192, 24
TRAIN_LANES, TRAIN_WINDOW = (32, 128), 32  # least and most lanes
TRAIN_STEPS = 256  # steps of the parameters before lanes are added
RATE = 0.08
LOG10 = float(np.log(10.0))


class Network:
    """Parameters of the model for ``tail`` classes of rarer words."""

    def __init__(self, tail: int):
        h = HIDDEN
        self.shapes = {"enter": (HEAD + tail, 3 * h), "recur": (h, 3 * h), "group": (h, GROUPS + tail),
                       "group_bias": (GROUPS + tail,), "word": (GROUPS, h, WIDTH), "word_bias": (GROUPS, WIDTH)}

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes.values())

    def load(self, flat: np.ndarray) -> "Network":
        """Output weights lie in ``group_all`` and ``word_all`` with their
        biases as a last row, which one product with a column of ones adds."""
        h, at = HIDDEN, 0
        self.enter, self.recur = (np.empty(self.shapes[name], np.float32) for name in ("enter", "recur"))
        self.group_all = np.empty((h + 1, self.shapes["group"][1]), np.float32)
        self.word_all = np.empty((GROUPS, h + 1, WIDTH), np.float32)
        self.group, self.group_bias = self.group_all[:h], self.group_all[h]
        self.word, self.word_bias = self.word_all[:, :h], self.word_all[:, h]
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            getattr(self, name)[...] = flat[at: at + n].reshape(shape)
            at += n
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.shapes])

    def start(self, words: np.ndarray, classes: np.ndarray, seed: int = 20240917) -> "Network":
        """Biases from the counts of the head's words and of the rarer
        classes, small random weights elsewhere."""
        rng = np.random.default_rng(seed)
        self.load(rng.normal(0, 0.1, self.size).astype(np.float32))
        counts = np.zeros(HEAD)
        counts[: len(words)] = words
        groups = np.concatenate([counts.reshape(GROUPS, WIDTH).sum(1), classes]) + 0.5
        self.group_bias[:] = np.log(groups / groups.sum())
        inside = counts.reshape(GROUPS, WIDTH)
        self.word_bias[:] = np.log((inside + 1e-3) / (inside + 1e-3).sum(1, keepdims=True))
        self.group *= 0.1
        self.word *= 0.1
        return self


def lanes(codes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lay texts into at most ``width`` lanes of about equal length, longest
    first: (target codes, codes before them, text of each place or -1, length
    of each lane), places by step and lane, lanes by falling length.  Code 0,
    the end, stands before a text's first token."""
    order = np.argsort(-sizes, kind="stable")
    width = max(1, min(width, len(sizes)))
    heap = [(0, lane) for lane in range(width)]
    held: list[list[int]] = [[] for _ in range(width)]
    for text in order.tolist():
        used, lane = heapq.heappop(heap)
        held[lane].append(text)
        heapq.heappush(heap, (used + int(sizes[text]), lane))
    length = np.array([int(sizes[h].sum()) for h in held])
    by = np.argsort(-length, kind="stable")
    length = length[by]
    first = np.cumsum(sizes) - sizes
    target = np.zeros((int(length[0]), width), np.uint16)
    owner = np.full(target.shape, -1, np.int32)
    before = np.zeros_like(target)
    for place, lane in enumerate(by.tolist()):
        at = 0
        for text in held[lane]:
            n = int(sizes[text])
            span = codes[first[text]: first[text] + n]
            target[at: at + n, place] = span
            before[at + 1: at + n, place] = span[:-1]
            owner[at: at + n, place] = text
            at += n
    return target, before, owner, length


def _starts(owner: np.ndarray, at: int, end: int) -> np.ndarray:
    """Where a text begins, for the steps ``at`` to ``end``."""
    if at == 0:
        out = np.ones(owner[:end].shape, bool)
        out[1:] = owner[1:end] != owner[: end - 1]
        return out
    return owner[at:end] != owner[at - 1: end - 1]


def _by_group(target: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Places of flat targets (those ``inside``) ordered by the class of their
    output, their targets and classes, and (group, first, end) of the frequent
    words, which come first."""
    goal = target if inside is None else target[inside]
    group = np.where(goal < HEAD, goal // WIDTH, goal - (HEAD - GROUPS)).astype(np.uint16)
    order = np.argsort(group, kind="stable")
    group = group[order]
    cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    return (order if inside is None else inside[order], goal[order], group.astype(np.int64),
            [(g, a, b) for g, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a])


def _outputs(hidden: np.ndarray, places: np.ndarray) -> np.ndarray:
    """States of ``places`` with a column of ones for the biases."""
    flat = np.ones((len(places), HIDDEN + 1), np.float32)
    flat[:, :HIDDEN] = hidden.reshape(-1, HIDDEN).take(places, 0)
    return flat


def _inside(net: "Network", flat: np.ndarray, groups: list[tuple[int, int, int]]) -> np.ndarray:
    """Logits of the words in each frequent word's group."""
    out = np.empty((groups[-1][2], WIDTH), np.float32)
    for g, a, b in groups:
        np.matmul(flat[a:b], net.word_all[g], out=out[a:b])
    return out


_SAFE = 60.0  # float32 powers of e and their sums stay finite up to there


def _powers(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of e of the rows, in place: (flat place of column ``at`` of each
    row, logits there, sums of the rows)."""
    most = float(logits.max())
    if most > _SAFE or most < -_SAFE:
        logits -= logits.max(1, keepdims=True)
    places = np.arange(len(at)) * logits.shape[1] + at
    own = logits.ravel().take(places)
    np.exp(logits, out=logits)
    return places, own, logits @ np.ones(logits.shape[1], np.float32)


def _picked(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of column ``at`` of each row."""
    _, own, total = _powers(logits, at)
    return own - np.log(total)


def _soft(logits: np.ndarray, at: np.ndarray, n: int) -> float:
    """Probabilities less one at column ``at`` of each row over ``n``, in
    place: the slope of the mean loss.  The summed loss is returned."""
    places, own, total = _powers(logits, at)
    logits *= (np.reciprocal(total) / np.float32(n))[:, None]
    logits.reshape(-1)[places] -= np.float32(1 / n)
    return float(np.log(total).sum() - own.sum())


def _recurrent(net: "Network") -> np.ndarray:
    """The recurrent weights as one block for each gate (both with their sign
    turned, as ``_advance`` takes them) and one for the new state."""
    blocks = net.recur.reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2).copy()
    np.negative(blocks[:2], out=blocks[:2])
    return blocks


def _entered(net: "Network", before: np.ndarray) -> np.ndarray:
    """Rows of the codes in blocks as in ``_recurrent``: 3 x steps x lanes."""
    at = before.astype(np.int64) * 3 + np.arange(3)[:, None, None]
    return net.enter.reshape(-1, HIDDEN).take(at, 0)


def _advance(now: np.ndarray, enter: np.ndarray, recur: np.ndarray, s: np.ndarray, fill: np.ndarray, out: np.ndarray) -> None:
    """One step of all lanes from the state ``now`` to ``out``.  ``s`` gets
    both gates and what the reset gate weighs, ``fill`` the new state."""
    np.matmul(now, recur, out=s)
    gates = s[:2]
    np.subtract(gates, enter[:2], out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(s[0], s[2], out=fill)
    fill += enter[2]
    fill *= -2  # tanh(x) = 2 / (1 + exp(-2 x)) - 1, which takes half the time of np.tanh
    np.exp(fill, out=fill)
    fill += 1
    np.divide(2, fill, out=fill)
    fill -= 1
    np.subtract(now, fill, out=out)
    out *= s[1]
    out += fill


def score(net: Network, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log probability of each text's codes."""
    out = np.zeros(len(sizes))
    if not len(sizes):
        return out
    target, before, owner, length = lanes(codes, sizes, SCORE_LANES)
    h = HIDDEN
    state, recur = np.zeros((target.shape[1], h), np.float32), _recurrent(net)
    with np.errstate(over="ignore"):  # exp of a large number is infinite and its gate 0
        for at in range(0, len(target), SCORE_WINDOW):
            end = min(at + SCORE_WINDOW, len(target))
            live = int(np.searchsorted(-length, -at, "left"))  # lanes longer than ``at``
            enter = _entered(net, before[at:end, :live])
            begins = _starts(owner[:, :live], at, end)
            any_begins = begins.any(1).tolist()
            hidden = np.empty((end - at, live, h), np.float32)
            s, fill, now = np.empty((3, live, h), np.float32), np.empty((live, h), np.float32), state[:live]
            for t in range(end - at):
                if any_begins[t]:
                    now = now.copy()
                    now[begins[t]] = 0
                _advance(now, enter[:, t], recur, s, fill, hidden[t])
                now = hidden[t]
            state[:live] = now
            text, goal = owner[at:end, :live].ravel(), target[at:end, :live].ravel()
            places, goal, group, groups = _by_group(goal, np.flatnonzero(text >= 0) if text.min() < 0 else None)
            flat = _outputs(hidden, places)
            gain = _picked(flat @ net.group_all, group).astype(np.float64)
            if groups:
                frequent = groups[-1][2]
                gain[:frequent] += _picked(_inside(net, flat, groups), goal[:frequent] % WIDTH)
            out += np.bincount(text[places], gain, len(sizes))
    return out


_LONG = 12  # places of a code that are summed at once


def _sums(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, sums of their rows of ``values``).  Codes with few
    places are summed place by place over all of them."""
    order = np.argsort(codes, kind="stable")
    ordered, values = codes[order], values.take(order, 0)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    many = np.diff(np.append(first, len(ordered)))
    by = np.argsort(-many, kind="stable")
    first, many = first[by], many[by]
    out = values[first]
    long = int(np.searchsorted(-many, -_LONG, "right"))
    for i, (a, n) in enumerate(zip(first[:long].tolist(), many[:long].tolist())):
        values[a: a + n].sum(0, out=out[i])
    for k in range(1, _LONG - 1):
        end = int(np.searchsorted(-many, -k, "left"))  # codes with more than k places
        if end <= long:
            break
        out[long:end] += values[first[long:end] + k]
    return ordered[first], out


class Trainer:
    """Truncated backpropagation through time over texts that come in parts:
    the state runs on from window to window, the gradient stops at a window's
    start.  Every token is learned from once."""

    def __init__(self, net: Network, rate: float = RATE):
        self.net, self.rate = net, rate
        self.square = {name: np.full_like(getattr(net, name), 1e-6) for name in ("enter", "recur", "group_all", "word_all")}
        self.loss, self.tokens = 0.0, 0
        self.room: dict[str, np.ndarray] = {}

    def learn(self, texts: list[np.ndarray]) -> None:
        if texts:
            self.pass_over(np.concatenate(texts), np.array([len(t) for t in texts]))

    def _step(self, name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        """``grad`` is overwritten."""
        values, seen = getattr(self.net, name), self.square[name]
        total = grad * grad
        if rows is None:
            seen += total
            np.sqrt(seen, out=total)
        else:
            total += seen.take(rows, 0)
            seen[rows] = total
            np.sqrt(total, out=total)
        grad *= self.rate
        grad /= total
        if rows is None:
            values -= grad
        else:
            values[rows] -= grad

    def _array(self, name: str, *shape: int) -> np.ndarray:
        """An array whose memory serves the next window again."""
        size = int(np.prod(shape))
        if name not in self.room or self.room[name].size < size:
            self.room[name] = np.empty(size, np.float32)
        return self.room[name][:size].reshape(shape)

    def pass_over(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        least, most = TRAIN_LANES
        target, before, owner, length = lanes(codes, sizes, min(most, max(least, len(codes) // (TRAIN_WINDOW * TRAIN_STEPS))))
        state = np.zeros((target.shape[1], HIDDEN), np.float32)
        with np.errstate(over="ignore"):  # exp of a large number is infinite and its gate 0
            for at in range(0, len(target), TRAIN_WINDOW):
                end = min(at + TRAIN_WINDOW, len(target))
                live = int(np.searchsorted(-length, -at, "left"))
                self._window(target[at:end, :live], before[at:end, :live], owner[at:end, :live] >= 0,
                             _starts(owner[:, :live], at, end), state[:live])

    def _window(self, target: np.ndarray, before: np.ndarray, there: np.ndarray, begins: np.ndarray, state: np.ndarray) -> None:
        """Steps x lanes of one window; ``state`` is moved on."""
        net, h = self.net, HIDDEN
        steps, live = target.shape
        enter, recur = _entered(net, before), _recurrent(net)
        any_begins = begins.any(1).tolist()
        was, hidden, fill = (self._array(name, steps, live, h) for name in ("was", "hidden", "fill"))
        s = self._array("s", 3, steps, live, h)
        now = state
        for t in range(steps):
            was[t] = now
            if any_begins[t]:
                was[t, begins[t]] = 0
            now = hidden[t]
            _advance(was[t], enter[:, t], recur, s[:, t], fill[t], now)
        state[:] = now
        whole = bool(there.all())
        places, goal, group, groups = _by_group(target.ravel(), None if whole else np.flatnonzero(there.ravel()))
        flat, n = _outputs(hidden, places), len(places)
        share = flat @ net.group_all
        self.loss += _soft(share, group, n)
        pull = share @ net.group.T
        dgroup, dword = flat.T @ share, np.zeros_like(net.word_all)
        if groups:
            part = _inside(net, flat, groups)
            self.loss += _soft(part, goal[: len(part)] % WIDTH, n)
            back = np.empty((len(part), h), np.float32)
            for g, a, b in groups:
                np.matmul(part[a:b], net.word[g].T, out=back[a:b])
                np.matmul(flat[a:b].T, part[a:b], out=dword[g])
            pull[: len(part)] += back
        self._step("word_all", dword)
        self._step("group_all", dgroup)
        above = (np.empty if whole else np.zeros)((steps * live, h), np.float32)
        above[places] = pull
        above = above.reshape(steps, live, h)
        # Slopes that do not depend on what comes back from later steps.
        reset, keep, sums = s
        rest = 1 - keep
        by_keep = was - fill
        by_keep *= keep
        by_keep *= rest
        fill *= fill
        by_fill = np.subtract(1, fill, out=fill)
        by_fill *= rest
        by_reset = np.subtract(1, reset, out=rest)
        by_reset *= reset
        by_reset *= sums
        slopes, dfill = self._array("slopes", 3, steps, live, h), self._array("dfill", steps, live, h)
        dreset, dkeep, dsum = slopes
        back = net.recur.reshape(h, 3, h).transpose(1, 2, 0).copy()
        d, made = np.zeros((live, h), np.float32), np.empty((3, live, h), np.float32)
        for t in range(steps - 1, -1, -1):
            d += above[t]
            np.multiply(d, by_fill[t], out=dfill[t])
            np.multiply(dfill[t], by_reset[t], out=dreset[t])
            np.multiply(dfill[t], reset[t], out=dsum[t])
            np.multiply(d, by_keep[t], out=dkeep[t])
            d *= keep[t]
            np.matmul(slopes[:, t], back, out=made)
            for more in made:
                d += more
            if any_begins[t]:
                d[begins[t]] = 0
        states = was.reshape(-1, h).T
        drecur = np.concatenate([states @ x.reshape(-1, h) for x in slopes], 1)
        self._step("recur", np.clip(drecur, -1, 1))
        into = np.concatenate([x.reshape(-1, h) for x in (dreset, dkeep, dfill)], 1)
        codes_in = before.ravel()
        if not whole:
            codes_in, into = codes_in[there.ravel()], into[there.ravel()]
        rows, denter = _sums(codes_in, into)
        self._step("enter", denter, rows)
        self.tokens += n


def train(net: Network, codes: np.ndarray, sizes: np.ndarray, rate: float = RATE) -> tuple[float, int]:
    """One pass over the texts: (summed loss, tokens)."""
    trainer = Trainer(net, rate)
    if len(sizes):
        trainer.pass_over(codes, sizes)
    return trainer.loss, trainer.tokens
