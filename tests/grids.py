"""Small fields, messages and manifests for the tests."""

import json

import numpy as np

from gridspark.sources.messages import encode

GRID = (4, 5)


def field(variable, hour, member):
    """Values that tell which field they belong to."""
    base = {"t2m": 0, "u10": 1000}.get(variable, 5000) + 100 * hour + 20 * member
    return (base + np.arange(GRID[0] * GRID[1])).astype("<f4")


def header(variable, hour, member, members, date=20240101, time=600):
    return {"shortName": {"t2m": "2t", "u10": "10u"}.get(variable, variable), "cfVarName": variable,
            "dataDate": date, "dataTime": time, "step": hour, "perturbationNumber": member + 1,
            "numberOfForecastsInEnsemble": members, "Nj": GRID[0], "Ni": GRID[1]}


def payload(variable, hour, members=3, **kw):
    return b"".join(encode(header(variable, hour, m, members, **kw), field(variable, hour, m).tobytes())
                    for m in range(members))


def manifest(file_id, variable, hour, path, release="2024-01-01T06:00:00.000Z"):
    return json.dumps({
        "file_id": file_id, "variable": variable, "forecast_hour": hour, "landing_path": str(path),
        "producer_write_start_utc": release, "producer_release_utc": release}, indent=2) + "\n"
