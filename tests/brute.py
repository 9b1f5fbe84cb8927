"""Plain-Python definitions of the results, for tables of a few rows."""

from itertools import combinations
from math import log2


def itemsets(rows, items_of, measures, support, overlap=False):
    """``rows`` are dicts, ``items_of(row)`` a list of (attr, item)."""
    n = len(rows)
    found = {}
    for row in rows:
        items = sorted({(a, f"{a}={v}") for a, v in items_of(row)})
        for k in range(len(items) + 1):
            for combo in combinations(items, k):
                attrs = [a for a, _ in combo]
                if not overlap and len(set(attrs)) < len(attrs):
                    continue
                key = ", ".join(sorted(i for _, i in combo))
                entry = found.setdefault(key, [0] * (1 + len(measures)))
                entry[0] += 1
                for j, m in enumerate(measures):
                    entry[1 + j] += row[m]
    return {k: tuple(v) for k, v in found.items() if v[0] / n >= support or k == ""}


def tree(rows, attr, num, den, support, criterion):
    """Nodes ``(lo, hi, n, divergence)`` of one tree, by trying every cut."""
    total = len(rows)

    def p(part):
        d = sum(den(r) for r in part)
        return sum(num(r) for r in part) / d if d else None

    p0 = p(rows)

    def entropy(q):
        return sum(-x * log2(x) for x in (q, 1 - q) if x > 0)

    def value(q, parent):
        return {
            "divergence_criterion": abs(q - parent), "entropy": entropy(q),
            "weighted_sum_abs": abs(q - p0), "weighted_sum_pow": (q - p0) ** 2,
            "weighted_max_abs": abs(q - p0), "weighted_max_pow": (q - p0) ** 2,
        }[criterion]

    out = []

    def grow(part, lo, hi, div, last):
        out.append((lo, hi, len(part), round(div, 9)))
        best = None
        values = sorted({r[attr] for r in part})
        for v1, v2 in zip(values, values[1:]):
            left = [r for r in part if r[attr] <= v1]
            right = [r for r in part if r[attr] >= v2]
            if min(len(left), len(right)) / total < support:
                continue
            pl, pr = p(left), p(right)
            if pl is None or pr is None:
                continue
            parent = div + p0
            vl, vr = value(pl, parent), value(pr, parent)
            dl, dr = sum(den(r) for r in left), sum(den(r) for r in right)
            if criterion in ("entropy", "divergence_criterion"):
                split = dl / (dl + dr) * vl + dr / (dl + dr) * vr
            elif "sum" in criterion:
                split = len(left) / total * vl + len(right) / total * vr
            else:
                split = max(len(left) / total * vl, len(right) / total * vr)
            if split == last:
                continue
            if best is None or (split < best[0] if criterion == "entropy" else split > best[0]):
                best = (split, v1, v2, left, right, pl - p0, pr - p0)
        if best is None or (best[5] == div and best[6] == div):
            return
        split, v1, v2, left, right, dl_, dr_ = best
        grow(left, lo, v1, dl_, split)
        grow(right, v2, hi, dr_, split)

    grow(rows, None, None, 0.0, None)
    return sorted(out, key=repr)
