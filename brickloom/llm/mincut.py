"""Minimum cut of a small graph with a source and a sink capacity per node and undirected edges between nodes."""

from __future__ import annotations

from collections import deque


def source_side(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """scores: capacity from the source if positive, to the sink if negative. edges: (a, b, capacity both ways).

    Returns which nodes stay with the source: those that the residual graph of a maximum flow reaches. Flow is pushed in
    phases of shortest paths, each blocked by a search that never takes a dead end twice.
    """
    n = len(scores)
    excess = [max(s, 0) for s in scores]
    need = [max(-s, 0) for s in scores]
    head: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for a, b, c in edges:
        if c > 0 and a != b:
            head[a].append(len(to))
            head[b].append(len(to) + 1)
            to += (b, a)
            room += (c, c)

    def levels() -> tuple[list[int], bool]:
        level = [0 if e else -1 for e in excess]
        queue = deque(i for i in range(n) if excess[i])
        meets = False
        while queue:
            v = queue.popleft()
            meets = meets or need[v] > 0
            for k in head[v]:
                w = to[k]
                if room[k] and level[w] < 0:
                    level[w] = level[v] + 1
                    queue.append(w)
        return level, meets

    while True:
        level, meets = levels()
        if not meets:
            return [x >= 0 for x in level]
        turn = [0] * n
        for s in range(n):
            while excess[s]:
                path: list[int] = []
                v = s
                while need[v] == 0:
                    for i in range(turn[v], len(head[v])):
                        k = head[v][i]
                        if room[k] and level[to[k]] == level[v] + 1:
                            turn[v] = i
                            path.append(k)
                            v = to[k]
                            break
                    else:
                        turn[v] = len(head[v])
                        if not path:
                            break
                        v = to[path.pop() ^ 1]
                        turn[v] += 1
                if need[v] == 0:
                    break
                push = min([excess[s], need[v], *[room[k] for k in path]])
                excess[s] -= push
                need[v] -= push
                for k in path:
                    room[k] -= push
                    room[k ^ 1] += push
