"""Plain versions of the operators, for small inputs."""

import numpy as np


def repeated_lines(rows, run):
    """(id, text) -> kept text and number of deleted lines, documents in order."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        solid = [i for i, line in enumerate(lines) if line.strip(" \t\r")]
        gone = set()
        for k in range(len(solid) - run + 1):
            window = tuple(lines[i] for i in solid[k : k + run])
            if window in seen:
                gone.update(solid[k : k + run])
            seen.add(window)
        out.append((doc_id, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def repeated_bytes(rows, match=50):
    """(id, text) -> mask of bytes that go, in the order of rows."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, data in texts:
        for at in range(len(data) - match + 1):
            w = data[at : at + match]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, data in texts:
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - match + 1):
            if first[data[at : at + match]] < i:
                gone[at : at + match] = True
        out.append(gone)
    return out
