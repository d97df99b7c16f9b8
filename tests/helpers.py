"""Small reference computations written independently of the library."""

import numpy as np

from brickloom.lookups import PART_DIMENSIONS

DIMS = {p: (w, h, d) for p, w, h, d in PART_DIMENSIONS}
SCHEMA = "assembly_id string, part_index int, part_id string, color int, step_id int, page_num int, transform array<double>"


def pose(x=0.0, y=0.0, z=0.0, rot=None):
    m = np.eye(4)
    if rot is not None:
        m[:3, :3] = rot
    m[:3, 3] = (x, y, z)
    return m


def parts_df(spark, assemblies):
    rows = [
        (key, i, pid, color, step, step, [float(v) for v in m.flatten()])
        for key, parts in assemblies.items()
        for i, (pid, color, step, m) in enumerate(parts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def at(pid, x, y, z, color=4, step=0, rot=None):
    return (f"{pid}.dat", color, step, pose(x, y, z, rot))


def anchors(pid, m):
    w, h, d = DIMS[pid]
    n, k = max(1, int(round(w / 20))), max(1, int(round(d / 20)))
    grid = [(-10.0 * (n - 1) + 20 * i, -10.0 * (k - 1) + 20 * j) for i in range(n) for j in range(k)]
    studs = np.array([m @ [x, -h, z, 1] for x, z in grid])[:, :3]
    sockets = np.array([m @ [x, 0, z, 1] for x, z in grid])[:, :3]
    return studs, sockets


def corners(pid, m):
    w, h, d = DIMS[pid]
    box = [(sx * w / 2, y, sz * d / 2, 1) for sx in (-1, 1) for sz in (-1, 1) for y in (0, -h)]
    return np.array([m @ c for c in box])[:, :3]


def meets(a, b, reach):
    (sa, ka), (sb, kb) = anchors(a[0], a[3]), anchors(b[0], b[3])
    gap = min(np.linalg.norm(sa[:, None] - kb[None], axis=2).min(), np.linalg.norm(sb[:, None] - ka[None], axis=2).min())
    return gap < reach


def touch(a, b):
    ca, cb = corners(a[0], a[3])[:, 1], corners(b[0], b[3])[:, 1]
    if not (abs(ca.max() - cb.min()) < 2 or abs(cb.max() - ca.min()) < 2):
        return False
    return meets(a, b, 1.0)


def overlap(a, b):
    def frame(p):
        w, h, d = DIMS[p[0]]
        m = p[3]
        return (m @ [0, -h / 2, 0, 1])[:3], m[:3, :3], np.array([w / 2 - 0.1, h / 2 - 0.01, d / 2 - 0.1])

    (ca, ra, ha), (cb, rb, hb) = frame(a), frame(b)
    gap = cb - ca
    for i in range(3):
        if abs(gap @ ra[:, i]) > ha[i] + sum(hb[k] * abs(rb[:, k] @ ra[:, i]) for k in range(3)):
            return False
        if abs(gap @ rb[:, i]) > hb[i] + sum(ha[k] * abs(ra[:, k] @ rb[:, i]) for k in range(3)):
            return False
    for i in range(3):
        for j in range(3):
            axis = np.cross(ra[:, i], rb[:, j])
            if np.linalg.norm(axis) < 1e-5:
                continue
            reach = sum(ha[k] * abs(ra[:, k] @ axis) + hb[k] * abs(rb[:, k] @ axis) for k in range(3))
            if abs(gap @ axis) > reach:
                return False
    return True
