"""Plain loops over one month of one signal, written from the rules."""

from __future__ import annotations

from ampwise.schema import Params


def candidates(us: list[int], cur: list[float], p: Params, clean: bool = False) -> list[tuple]:
    """(start, next, end, status) for rows sorted by time; positions from 0, ends exclusive."""
    n = len(cur)
    dis = [c <= p.discharge for c in cur]
    chg = [c >= p.charge for c in cur]
    rest = [-p.rest <= c <= p.rest for c in cur]
    starts, last = [], None
    for i in range(n):
        if dis[i]:
            if last is not None and (us[i] - us[last]) // 1_000_000 > p.gap_s:
                starts.append(i)
            last = i
    out = []
    for start, nxt in zip(starts, starts[1:]):
        if start < p.eps1 or not all(rest[start - p.eps1 : start]):
            out.append((start, nxt, None, "context"))
            continue
        ahead = dis[start : start + p.alpha1]
        if len(ahead) < p.alpha1 or not all(ahead):
            out.append((start, nxt, None, "noise"))
            continue
        end = None
        if clean:
            end = next((i for i in range(start, nxt) if not dis[i]), nxt)
        else:
            seek = start + p.alpha1
            for s in range(seek + 1, nxt + 1):
                window = rest[s : s + p.eps2]
                if len(window) == p.eps2 and all(window) and sum(chg[seek:s]) >= p.alpha2:
                    end = s + p.eps2
                    break
        if end is None or end >= n:
            out.append((start, nxt, None, "incomplete"))
            continue
        late = (us[end] - us[start - p.eps1]) // 1_000_000 > (nxt - start) * p.period_s
        out.append((start, nxt, end, "inconsistent" if late else "valid"))
    return out


def blow_rows(cur: list[float], p: Params) -> list[tuple]:
    """(part, part_pos, blow_pos, episode position) of one episode, with sequence slicing as the rule."""
    d = next((i for i, c in enumerate(cur) if c <= p.discharge), None)
    c = next((i for i, v in enumerate(cur) if v >= p.charge), None)
    if d is None or c is None:
        return []
    index = list(range(len(cur)))
    first, second = index[d - p.eps1 : d + p.alpha1], index[c - p.alpha1 : c + p.alpha2]
    if not first or not second:
        return []
    out = [("discharge", i, i, row) for i, row in enumerate(first)]
    return out + [("charge", i, len(first) + i, row) for i, row in enumerate(second)]


def greedy_folds(sizes: list[int], k: int) -> list[int]:
    """Fold of each group, filled in order."""
    cap, fold, held, out = sum(sizes) // k, 0, 0, []
    for n in sizes:
        if held + n > cap and fold < k - 1:
            fold, held = fold + 1, 0
        held += n
        out.append(fold)
    return out
