"""The network of modes over the given events against a plain version that goes mode by mode."""

import math

import numpy as np
import pytest

from trackmill.functions.geodesic import inverse
from trackmill.plans import crossings
from trackmill.plans.tracks import tracks

SF = "/root/testdata/sf0.01"


def turn(a, b):
    return abs((b - a + 180) % 360 - 180)


def km(a, b, c, d):
    return float(inverse(a, b, c, d)[0])


def diagonal(lat):
    return math.hypot(km(0, lat, 10, lat), km(0, lat, 0, lat + 5 if lat + 5 <= 90 else lat - 5))


@pytest.fixture(scope="module")
def tables(spark):
    t = tracks(spark, SF)
    members, modes = crossings.mode_tables(t)
    return [r.asDict() for r in members.collect()], [r.asDict() for r in modes.collect()], [r.asDict() for r in crossings.network(t)[1].collect()], crossings.written(t).collect()


def source(r):
    return r["start_lon_bin"], r["start_lat_bin"], r["mode"]


def test_moments(tables):
    members, modes, _, matrix = tables
    assert len(modes) > 100 and {source(m) for m in members} == {source(m) for m in modes}
    for mode in modes:
        mine = [m for m in members if source(m) == source(mode)]
        n = np.array([m["transition_count"] for m in mine], float)
        w = n / n.sum()
        d, b = np.array([m["distance"] for m in mine]), np.array([m["bearing"] for m in mine])
        dx, dy = (w * d * np.sin(np.radians(b))).sum(), (w * d * np.cos(np.radians(b))).sum()
        mean = (w * d).sum()
        assert mode["n"] == n.sum() and mode["mean_km"] == pytest.approx(mean) and mode["sd_km"] == pytest.approx(math.sqrt((w * (d - mean) ** 2).sum()), abs=1e-4)
        if math.hypot(dx, dy) > 1:
            at = math.degrees(math.atan2(dx, dy)) % 360
            assert turn(at, mode["bearing"]) < 1e-6
            assert mode["angular_sd"] == pytest.approx(math.sqrt((w * ((b - at + 180) % 360 - 180) ** 2).sum()), abs=1e-4)
        cell = [m for m in matrix if (m["start_lon_bin"], m["start_lat_bin"]) == source(mode)[:2]]
        moving = sum(m["transition_count"] for m in cell if (m["end_lon_bin"], m["end_lat_bin"]) != source(mode)[:2])
        assert mode["p_moving"] == pytest.approx(n.sum() / moving) and mode["records"] == len(mine) == mode["end_cells"]
        why = [name for name, bad in (("low_start_count", sum(m["transition_count"] for m in cell) < 1), ("low_moving_count", moving < 1), ("low_mode_count", n.sum() < 1), ("low_mode_probability", n.sum() / moving < 0.02), ("short_mean_distance", False)) if bad]
        assert mode["reasons"] == ";".join(why) and mode["accepted"] == (not why)


def test_edges(tables):
    members, modes, edges, _ = tables
    good = {source(m): m for m in modes if m["accepted"]}
    by_cell = {}
    for m in good.values():
        by_cell.setdefault(source(m)[:2], []).append(m)
    want = []
    for key, mode in good.items():
        scale = max(mode["sd_km"], diagonal(mode["start_lat_center"]), 1.0)
        found = []
        for m in members:
            for to in by_cell.get((m["end_lon_bin"], m["end_lat_bin"]), []) if source(m) == key else []:
                c = {"cell": (m["end_lon_bin"], m["end_lat_bin"]), "mode": to["mode"], "at": (m["end_lon_center"], m["end_lat_center"]), "b": to["bearing"], "n": m["transition_count"], "p": m["transition_probability"], "turn": turn(m["bearing"], to["bearing"]), "km": m["distance"], "off": abs(m["distance"] - mode["mean_km"])}
                c["score"] = round(c["p"] / mode["p_all"] * math.exp(-0.5 * (c["turn"] / 30) ** 2) * math.exp(-0.5 * (c["off"] / scale) ** 2), 12)
                found.append(c)
        found.sort(key=lambda c: (-c["score"], c["cell"][1], c["cell"][0], c["mode"]))
        clusters = []
        for c in found:
            for cluster in clusters:
                if km(*cluster[0]["at"], *c["at"]) <= 1.5 * diagonal(c["at"][1]) and turn(cluster[0]["b"], c["b"]) <= 30:
                    cluster.append(c)
                    break
            else:
                clusters.append([c])
        mine = []
        for cluster in clusters:
            moves = {c["cell"]: c for c in cluster}.values()
            p = sum(c["p"] for c in cluster)
            e = {k: sum(c["p"] * c[k] for c in cluster) / p for k in ("turn", "km", "off")}
            e |= {"key": key, "to": (*cluster[0]["cell"], cluster[0]["mode"]), "n": sum(c["n"] for c in moves), "support": sum(c["p"] for c in moves) / mode["p_all"]}
            e["score"] = e["support"] * math.exp(-0.5 * (e["turn"] / 30) ** 2) * math.exp(-0.5 * (e["off"] / scale) ** 2)
            e["reasons"] = ";".join(name for name, bad in (("angular_mismatch", e["turn"] > 60), ("edge_too_long", e["km"] > 2000)) if bad)
            mine.append(e)
        able = sorted((e for e in mine if not e["reasons"]), key=lambda e: (-round(e["score"], 12), e["to"][1], e["to"][0], e["to"][2]))
        mass, cut = 0.0, None
        for e in able:
            if round(e["score"], 12) / round(able[0]["score"], 12) + 1e-15 < 0.35:
                e["reasons"] = "low_relative_score"
            elif mass >= 0.8 and not np.isclose(e["score"], cut):
                e["reasons"] = "beyond_cumulative_mass"
            else:
                mass += e["support"]
                cut = e["score"] if cut is None and mass >= 0.8 else cut
        want += mine
    got = {(source(e), (e["end_lon_bin"], e["end_lat_bin"], e["to_mode"])): e for e in edges}
    assert len(got) == len(edges) == len(want) > 50
    for e in want:
        g = got[e["key"], e["to"]]
        assert g["n"] == e["n"] and g["reasons"] == e["reasons"] and g["selected"] == (not e["reasons"]), (g, e)
        assert [g["support"], g["turn"], g["km"], g["score"]] == pytest.approx([e["support"], e["turn"], e["km"], e["score"]], abs=1e-6)
    assert len({e["reasons"] for e in want}) > 2


def test_components(spark, tables):
    _, modes, edges, _ = tables
    name = lambda a, b, mode: (b * 36 + a) * 1000 + mode
    root = {name(*source(m)): name(*source(m)) for m in modes if m["accepted"]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        if e["selected"]:
            a, b = sorted((find(name(*source(e))), find(name(e["end_lon_bin"], e["end_lat_bin"], e["to_mode"]))))
            root[b] = a
    from trackmill.plans import catalog

    got = {r.node: r.component for r in catalog.QUERIES["branch_network_components"](spark, SF).collect()}
    assert got == {x: find(x) for x in root}
