"""op4's feature against its definition in plain Python."""

import math
import random

import numpy as np
import pytest

from quorumlens.llm import media


def by_definition(rgb):
    rows, cols = len(rgb), len(rgb[0])
    n = rows * cols
    out, spread = [], []
    for c in range(3):
        values = [rgb[i][j][c] for i in range(rows) for j in range(cols)]
        mean = sum(values) / n
        out.append(str(sum(values) * 1000 // n))
        spread.append(math.sqrt(max(sum(v * v for v in values) / n - mean * mean, 0)))
    edges = lambda k: [*(int(k * i / 8) for i in range(8)), k]
    light = [[sum(rgb[i][j]) for j in range(cols)] for i in range(rows)]
    cells = [sum(light[i][j] for i in range(a, b) for j in range(c, d)) for a, b in zip(edges(rows), edges(rows)[1:]) for c, d in zip(edges(cols), edges(cols)[1:])]
    bits = "".join("1" if x * 64 > sum(cells) else "0" for x in cells)
    return out, spread, f"{int(bits, 2):016x}"


@pytest.mark.parametrize("rows, cols", [(8, 8), (16, 24), (17, 9), (40, 8)])
def test_feature(rows, cols):
    r = random.Random(rows * cols)
    for shade in (1, 40, 255):
        rgb = [[[r.randint(0, shade) for _ in range(3)] for _ in range(cols)] for _ in range(rows)]
        mean, spread, bits = by_definition(rgb)
        got = media.feature(np.array(rgb, np.uint8)).split(",")
        assert got[:3] == mean and got[6] == bits
        assert all(abs(int(a) - b * 1000) <= 1 for a, b in zip(got[3:6], spread))
