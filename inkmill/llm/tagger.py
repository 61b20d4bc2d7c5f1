"""A character-level bidirectional LSTM with a CRF on top, in numpy: training by back-propagation and batch tagging.

Gates use the piecewise linear sigmoid and cells the softsign x / (1 + |x|), in training as in tagging: numpy computes
both by a few vectorised steps, while its ``tanh`` goes through the mathematical library element by element on most
machines.
"""

from dataclasses import dataclass

import numpy as np

#: Units of each direction and width of a character's embedding.
HIDDEN, WIDTH = 24, 20
#: Windows that are tagged side by side: as many as fit the cache and the fast products of small matrices.
TOGETHER = 224
#: Slope of the gates' sigmoid, which is 0 and 1 beyond half its inverse.
SLOPE = 0.2


@dataclass
class Tagger:
    """Weights. ``vocabulary`` maps each code point to a row of ``embed``; gates are input, forget, output, candidate."""

    vocabulary: np.ndarray
    embed: np.ndarray
    into: np.ndarray  # 2 x WIDTH x 4H
    again: np.ndarray  # 2 x H x 4H
    bias: np.ndarray  # 2 x 1 x 4H
    out: np.ndarray  # 2H x K
    out_bias: np.ndarray
    change: np.ndarray  # K x K, from -> to
    first: np.ndarray  # K

    NAMES = ("embed", "into", "again", "bias", "out", "out_bias", "change", "first")


def new_tagger(vocabulary: np.ndarray, rows: int, tags: int, rng: np.random.Generator) -> Tagger:
    f = lambda *s, k: (rng.standard_normal(s) / np.sqrt(k)).astype(np.float32)
    bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
    bias[:, :, HIDDEN : 2 * HIDDEN] = 1
    return Tagger(vocabulary, f(rows, WIDTH, k=4), f(2, WIDTH, 4 * HIDDEN, k=WIDTH), f(2, HIDDEN, 4 * HIDDEN, k=HIDDEN), bias, f(2 * HIDDEN, tags, k=2 * HIDDEN), np.zeros(tags, np.float32), np.zeros((tags, tags), np.float32), np.zeros(tags, np.float32))


def _joined(m: Tagger) -> np.ndarray:
    """The weights of a step, 2 x 4H x (H + WIDTH + 1): of the last state, of a character's embedding and of a constant 1.

    Slope and middle of the gates' sigmoid go into them, so that what comes out of the product only has to be clipped.
    """
    joined = np.concatenate([m.again, m.into, m.bias], 1)
    joined[:, :, : 3 * HIDDEN] *= SLOPE
    joined[:, -1, : 3 * HIDDEN] += 0.5
    return np.ascontiguousarray(joined.transpose(0, 2, 1))


def _aligned(n: int, kind: type = np.float32) -> np.ndarray:
    """An empty array that begins with a line of the cache, as wide loads across two lines take twice the time."""
    spare = np.empty(n * np.dtype(kind).itemsize + 64, np.uint8)
    at = -spare.ctypes.data % 64
    return spare[at : at + n * np.dtype(kind).itemsize].view(kind)


def _clip(x: np.ndarray, zero: np.ndarray, one: np.ndarray) -> None:
    """Into [0, 1] in place. Between whole arrays, as numpy is several times slower with scalars here."""
    np.maximum(x, zero, out=x)
    np.minimum(x, one, out=x)


def gradients(m: Tagger, ids: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood of a padded batch (B x T) and its gradients.

    Both directions begin with a line's own first and last character, so that padding comes last in both and nothing
    that counts is computed from it. Arrays are T x units x 2 x B, so that every gate of a step is contiguous.
    """
    b, t = ids.shape
    h, kind = HIDDEN, m.embed.dtype
    length = mask.sum(1)
    ahead = np.arange(t)[:, None]
    turn = np.where(ahead < length, length - 1 - ahead, ahead)  # T x B: the same place counted from the other end
    turn_flat = (turn * b + np.arange(b)).ravel()
    turned = lambda x: np.take(x.reshape(t * b, -1), turn_flat, axis=0).reshape(t, b, -1)
    both = np.stack([ids.T, np.take_along_axis(ids.T, turn, 0)], 1)  # T x 2 x B
    weights = _joined(m)
    back_weights = np.ascontiguousarray(weights.transpose(0, 2, 1))
    wide = weights.shape[2]
    new = lambda *shape: _aligned(int(np.prod(shape)), kind).reshape(shape)
    by_side = lambda x: x.swapaxes(-3, -2)  # noqa: E731  units x 2 x B as 2 x units x B
    given = new(t + 1, wide, 2, b)  # state, embedding and 1
    given[0, :h] = 0
    given[:t, h:-1] = m.embed[both].transpose(0, 3, 1, 2)
    given[:, -1] = 1
    gates, cells, shown = new(t, 4 * h, 2, b), new(t + 1, h, 2, b), new(t, h, 2, b)
    spare, zero, one = new(h, 2, b), new(3 * h, 2, b), new(3 * h, 2, b)
    cells[0], zero[:], one[:] = 0, 0, 1
    unit = one[:h]
    for k in range(t):
        g, c, x = gates[k], cells[k + 1], shown[k]
        np.matmul(weights, by_side(given[k]), out=by_side(g))
        _clip(g[: 3 * h], zero, one)
        fresh = g[3 * h :]
        np.abs(fresh, out=spare)
        np.add(spare, unit, out=spare)
        np.divide(fresh, spare, out=fresh)
        np.multiply(g[h : 2 * h], cells[k], out=c)
        np.multiply(g[:h], fresh, out=spare)
        np.add(c, spare, out=c)
        np.abs(c, out=spare)
        np.add(spare, unit, out=spare)
        np.divide(c, spare, out=x)
        np.multiply(g[2 * h : 3 * h], x, out=given[k + 1, :h])
    state = by_side(given[1:, :h])
    out = m.out.reshape(2, h, -1)
    emit = np.matmul(state.transpose(0, 1, 3, 2), out)  # T x 2 x B x K
    emit = emit[:, 0] + turned(emit[:, 1]) + m.out_bias
    # CRF: sums from both ends as scaled probabilities, in one pass, and the score of the given tags.
    n = emit.shape[2]
    top = emit.max(2, keepdims=True)
    like = np.exp(emit - top)
    like = np.stack([like, turned(like)], 1)  # T x 2 x B x K
    step = np.exp(m.change)
    steps = np.stack([step, np.ascontiguousarray(step.T)])
    before, now, size = np.empty((t, 2, b, n), kind), np.empty((t, 2, b, n), kind), np.empty((t, 2, b, 1), kind)
    before[0, 0], before[0, 1] = np.exp(m.first), 1
    for i in range(t):
        if i:
            np.matmul(now[i - 1], steps, out=before[i])
        np.multiply(before[i], like[i], out=now[i])
        np.add.reduce(now[i], axis=2, keepdims=True, out=size[i])
        np.divide(now[i], size[i], out=now[i])
    on = mask.T
    total = np.where(on, np.log(size[:, 0, :, 0].astype(float)) + top[..., 0], 0).sum(0)
    alpha, beta, later = now[:, 0], turned(before[:, 1]), turned(now[:, 1])
    d_emit = alpha * beta
    d_emit *= on[..., None] / d_emit.sum(2, keepdims=True)
    place, row = np.nonzero(on)
    tag = tags[row, place]
    d_emit[place, row, tag] -= 1
    d_emit = (d_emit / b).astype(kind)
    # Expected and given steps from tag to tag.
    weight = (before[1:, 0] * later[1:]).sum(2, keepdims=True)
    later = np.where(on[1:, :, None], later[1:] / np.maximum(weight, 1e-30), 0)
    d_change = (alpha[:-1].reshape(-1, n).T @ later.reshape(-1, n)) * step
    both_on = mask[:, 1:]
    pairs = tags[:, :-1][both_on] * n + tags[:, 1:][both_on]
    d_change = d_change - np.bincount(pairs, minlength=n * n).reshape(n, n)
    score = m.first[tags[:, 0]] + np.bincount(row, emit[place, row, tag], b) + (m.change[tags[:, :-1], tags[:, 1:]] * both_on).sum(1)
    d_both = np.stack([d_emit, turned(d_emit)], 1)  # T x 2 x B x K
    d = {"change": d_change / b, "first": d_emit[0].sum(0), "out_bias": d_emit.sum((0, 1)), "out": np.matmul(state, d_both).sum(0).reshape(2 * h, n)}
    # Back through the steps; what a step needs stays in the cache.
    d_state, d_given = new(t, h, 2, b), new(t + 1, wide, 2, b)
    np.matmul(out, d_both.transpose(0, 1, 3, 2), out=by_side(d_state))
    d_weights, more = np.zeros_like(weights), np.empty_like(weights)
    d_given[t, :h] = 0
    dg, opened, dc, other = new(4 * h, 2, b), new(3 * h, 2, b), new(h, 2, b), new(h, 2, b)
    dc[:] = 0
    for i in range(t - 1, -1, -1):
        g, dh = gates[i], d_state[i]
        np.add(dh, d_given[i + 1, :h], out=dh)
        # The gates' sigmoid has a slope where it is neither 0 nor 1, where x - x x is above 0.
        sigmoids = g[: 3 * h]
        np.multiply(sigmoids, sigmoids, out=opened)
        np.subtract(sigmoids, opened, out=opened)
        np.ceil(opened, out=opened)
        # The softsign's slope is (1 - |y|) ** 2 of its value y.
        np.abs(shown[i], out=spare)
        np.subtract(unit, spare, out=spare)
        np.multiply(spare, spare, out=spare)
        np.multiply(spare, g[2 * h : 3 * h], out=spare)
        np.multiply(spare, dh, out=spare)
        np.add(dc, spare, out=dc)
        fresh = g[3 * h :]
        np.multiply(dc, fresh, out=dg[:h])
        np.multiply(dc, cells[i], out=dg[h : 2 * h])
        np.multiply(dh, shown[i], out=dg[2 * h : 3 * h])
        np.multiply(dg[: 3 * h], opened, out=dg[: 3 * h])
        np.abs(fresh, out=spare)
        np.subtract(unit, spare, out=spare)
        np.multiply(spare, spare, out=spare)
        np.multiply(dc, g[:h], out=other)
        np.multiply(spare, other, out=dg[3 * h :])
        np.multiply(dc, g[h : 2 * h], out=dc)
        np.matmul(back_weights, by_side(dg), out=by_side(d_given[i]))
        np.matmul(by_side(dg), given[i].transpose(1, 2, 0), out=more)
        np.add(d_weights, more, out=d_weights)
    d_weights = d_weights.transpose(0, 2, 1)
    d_weights[:, :, : 3 * h] *= SLOPE
    d["again"], d["into"], d["bias"] = d_weights[:, :h], d_weights[:, h:-1], d_weights[:, -1:]
    key = both.ravel()
    d["embed"] = np.stack([np.bincount(key, d_given[:t, h + w].ravel(), len(m.embed)) for w in range(wide - h - 1)], 1)
    return float((total - score).mean()), d


def train(m: Tagger, batches, epochs: int, rate: float = 0.012) -> list[float]:
    """Adam over ``batches(epoch)``, each (ids, tags, mask); the rate falls to a tenth. Returns the loss per epoch."""
    # All weights lie in one array, so that a step is a few operations.
    flat = np.concatenate([getattr(m, n).ravel() for n in m.NAMES])
    ends = np.cumsum([getattr(m, n).size for n in m.NAMES])
    for n, end in zip(m.NAMES, ends.tolist()):
        own = getattr(m, n)
        setattr(m, n, flat[end - own.size : end].reshape(own.shape))
    first, second, spare = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    step, losses = 0, []
    for e in range(epochs):
        lr, total, n = rate * (1 - 0.9 * e / max(1, epochs - 1)), 0.0, 0
        for ids, tags, mask in batches(e):
            loss, d = gradients(m, ids, tags, mask)
            g = np.concatenate([d[name].ravel() for name in m.NAMES]).astype(flat.dtype, copy=False)
            g *= min(1.0, 5 / (float(np.sqrt(np.square(g).sum(dtype=float))) + 1e-9))
            step += 1
            first *= 0.9
            np.multiply(g, 0.1, out=spare)
            first += spare
            second *= 0.99
            g *= g
            g *= 0.01
            second += g
            np.divide(second, 1 - 0.99**step, out=g)
            np.sqrt(g, out=g)
            g += 1e-8
            np.divide(first, g, out=spare)
            spare *= lr / (1 - 0.9**step)
            flat -= spare
            total, n = total + loss, n + 1
        losses.append(total / max(1, n))
    return losses


def emissions(m: Tagger, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Scores of every tag at every code point of windows ``[start, start + size)``, one row after the other.

    ``TOGETHER`` windows run side by side in both directions, longest first; those that are over go sixteen at a time.
    Arrays are units x 2 x windows, so that every gate is contiguous. Scores are kept step by step and brought into the
    order of the text at the end.
    """
    h = HIDDEN
    order = np.argsort(-size, kind="stable")
    begin = np.cumsum(size) - size
    weights, embed = _joined(m), np.ascontiguousarray(m.embed.T)
    wide = weights.shape[2]
    out = m.out.reshape(2, h, -1)
    ids = m.vocabulary[points].astype(np.intp)
    emit = np.empty((int(size.sum()), out.shape[2]), np.float32)
    # Buffers are made once and stay in the cache.
    buffers = [_aligned(2 * k * TOGETHER) for k in (wide, 4 * h, h, h)]
    zeros, ones = _aligned(2 * 3 * h * TOGETHER), _aligned(2 * 3 * h * TOGETHER)
    zeros[:], ones[:] = 0, 1
    for low in range(0, len(size), TOGETHER):
        own = order[low : low + TOGETHER]
        here, sizes, n = start[own], size[own], len(own)
        steps = int(sizes[0])
        at = np.minimum(np.arange(steps)[:, None], sizes - 1)
        chars = np.stack([ids[here + at], ids[here + sizes - 1 - at]], 1)  # steps x 2 x n
        running = -(-np.searchsorted(-sizes, -np.arange(steps)) // 16) * 16  # windows that are not over, rounded up
        scores = np.empty((steps, 2, n, out.shape[2]), np.float32)
        live, kept = 0, None
        for i, k in enumerate(np.minimum(running, n).tolist()):
            if k != live:
                kept = None if kept is None else (given[:h, :, :k].copy(), cell[:, :, :k].copy())  # noqa: F821
                live = k
                given, gate, cell, spare = (x[: 2 * r * k].reshape(r, 2, k) for x, r in zip(buffers, (wide, 4 * h, h, h)))
                given[:h], cell[:] = kept or (0, 0)
                given[-1] = 1
                zero, one, unit = (x[: 2 * r * k].reshape(r, 2, k) for x, r in ((zeros, 3 * h), (ones, 3 * h), (ones, h)))
                state, units, seen = given[:h], given[h:-1], gate[: 3 * h]
                enter, forget, leave, fresh = gate.reshape(4, h, 2, k)
                by_side, to_side, by_window, kept = given.transpose(1, 0, 2), gate.transpose(1, 0, 2), state.transpose(1, 2, 0), True
            np.take(embed, chars[i, :, :k], axis=1, out=units, mode="clip")
            np.matmul(weights, by_side, out=to_side)
            _clip(seen, zero, one)
            np.abs(fresh, out=spare)
            np.add(spare, unit, out=spare)
            np.divide(fresh, spare, out=spare)
            np.multiply(spare, enter, out=spare)
            np.multiply(cell, forget, out=cell)
            np.add(cell, spare, out=cell)
            np.abs(cell, out=spare)
            np.add(spare, unit, out=spare)
            np.divide(cell, spare, out=spare)
            np.multiply(leave, spare, out=state)
            np.matmul(by_window, out, out=scores[i, :, :k])
        for w, (a, z) in enumerate(zip(begin[own].tolist(), sizes.tolist())):
            np.add(scores[:z, 0, w], scores[:z, 1, w][::-1], out=emit[a : a + z])
    emit += m.out_bias
    return emit


def best_paths(m: Tagger, emit: np.ndarray, begin: np.ndarray, size: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Tags of the best path of every stretch ``[begin, begin + size)``, 0 elsewhere; ``TOGETHER`` run side by side, longest first.

    ``opens`` and ``closes`` say which stretches begin and end their window; before and after the others is tag 0. The
    way back looks for the best step only into the tag a path has, so the way there keeps nothing but scores.
    """
    path = np.zeros(len(emit), np.int8)
    order = np.argsort(-size, kind="stable")
    change, into = m.change[:, :, None], np.ascontiguousarray(m.change.T)
    for low in range(0, len(order), TOGETHER):
        own = order[low : low + TOGETHER]
        at, sizes = begin[own], size[own]
        running = (len(own) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), "right")).tolist()
        scores = [np.where(opens[own][:, None], m.first, m.change[0]) + emit[at]]
        for i, n in enumerate(running[1:], 1):
            last = np.ascontiguousarray(scores[-1][:n].T)
            scores.append((last[:, None] + change).max(0).T + emit[at[:n] + i])
        leave = np.where(closes[own][:, None], 0, m.change[:, 0])
        tag = np.zeros(len(own), np.int64)
        over = 0  # stretches longer than step i + 1, whose tag is known
        for i in range(len(running) - 1, -1, -1):
            n = running[i]
            tag[over:n] = (scores[i][over:n] + leave[over:n]).argmax(1)
            path[at[:n] + i] = tag[:n]
            if i:
                tag[:n] = (scores[i - 1][:n] + into[tag[:n]]).argmax(1)
            over = n
    return path


def undecided(m: Tagger, emit: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of windows that a best path may tag other than 0.

    A stretch of other tags is on a best path only if it gains on tag 0. What a position adds is bounded with the best
    step into its tag, from 0 or a window's start where the stretch begins there, from another tag elsewhere; ``leave``
    bounds the step out of the stretch. So a position matters only if the largest running sum from it on exceeds the
    smallest before a stretch that holds it.
    """
    plain = min(m.change[0, 0], m.first[0])
    leave = max(0.0, float((m.change[1:, 0] - m.change[0, 0]).max()))
    opens, goes_on = np.maximum(m.change[0, 1:], m.first[1:]) - plain, m.change[1:, 1:].max(0) - m.change[0, 0]
    most = np.empty((2, len(emit)), np.float32)
    for low in range(0, len(emit), 8192):  # what stays in the cache
        columns = np.ascontiguousarray(emit[low : low + 8192].T)
        spare = np.empty_like(columns[0])
        for best, add in zip(most[:, low : low + 8192], (opens, goes_on)):
            best[:] = -np.inf
            for c, x in zip(columns[1:], add.tolist()):
                np.maximum(best, np.add(c, x, out=spare), out=best)
            best -= columns[0]
    opening = most[0].astype(np.float64)
    total = np.cumsum(most[1], dtype=np.float64)
    total -= np.repeat(total[begin], size)
    # Windows are put far below each other, so that running extremes stay within a window.
    total -= np.repeat(np.arange(len(size)), size) * (2 * (np.abs(total).max() + np.abs(opening).max() + leave) + 1 if len(total) else 0)
    low = np.minimum.accumulate(total - opening)
    high = np.maximum.accumulate(total[::-1])[::-1]
    # Rounding of the long sums must not decide; a position too many only takes time.
    return np.flatnonzero(high - low > -leave - 1e-3)
