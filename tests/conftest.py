import os
import sys

import pytest
from fixtures import DISKS

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

@pytest.fixture(scope="session")
def spark():
    from cytofleet.session import build_session

    s = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def disk_field(spark):
    """Five disk cells on a 448 x 448 field: (pixels, labels, fields)."""
    import numpy as np
    import pandas as pd

    n = 448
    yy, xx = np.mgrid[0:n, 0:n]
    cell, nuc = np.zeros((n, n), int), np.zeros((n, n), int)
    glyc, pax = np.zeros((n, n)), np.zeros((n, n))
    rng = np.random.default_rng(42)
    for i, (cy, cx, r, rn) in DISKS.items():
        d2 = (yy - cy) ** 2 + (xx - cx) ** 2
        cell[d2 < r * r] = i
        nuc[d2 < rn * rn] = i
        glyc[(d2 >= r * r) & (d2 < (r + 6) ** 2)] = 1.0
        for k in range(8):
            a, q = 2 * np.pi * k / 8, rng.uniform(0.78, 0.9) * r
            py, px = int(cy + q * np.sin(a)), int(cx + q * np.cos(a))
            pax[(yy - py) ** 2 + (xx - px) ** 2 <= 4] = 1.0
    yap = np.where(nuc > 0, 2.0, np.where(cell > 0, 1.0, 0.0))
    act = (cell > 0).astype(float)
    # keep a margin around the cells only: the rest is empty background
    near = np.zeros((n, n), bool)
    for cy, cx, r, _ in DISKS.values():
        near |= (yy - cy) ** 2 + (xx - cx) ** 2 < (r + 20) ** 2
    y, x = np.nonzero(near)
    frames = []
    for name, img in (("glycocalyx", glyc), ("yap", yap), ("paxillin", pax), ("actin", act)):
        frames.append(pd.DataFrame({"field_id": 1, "channel": name, "y": y, "x": x, "value": img[near]}))
    px = pd.concat(frames).astype({"y": "int32", "x": "int32", "field_id": "int64"})
    ly, lx = np.nonzero(cell)
    lab = pd.DataFrame({"field_id": 1, "y": ly, "x": lx, "cell_id": cell[ly, lx], "nucleus_id": nuc[ly, lx]}).astype(
        {"y": "int32", "x": "int32", "cell_id": "int32", "nucleus_id": "int32", "field_id": "int64"})
    f = spark.createDataFrame([(1, n, n, 0.325)], "field_id long, height int, width int, pixel_size_um double")
    return spark.createDataFrame(px).cache(), spark.createDataFrame(lab).cache(), f
