import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridspark import runtime  # noqa: E402
from tests.grids import manifest, payload  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = runtime.session(
        "tests", master="local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false",
        spark_driver_memory="6g", spark_ui_showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    runtime.clean(session)
    session.stop()


@pytest.fixture
def landing(tmp_path):
    """Six good payloads with manifests, one manifest cut short, one without payload, one
    payload cut short, one empty."""
    folder = tmp_path / "landing"
    folder.mkdir()
    for variable in ("t2m", "u10"):
        for hour in (0, 1, 2):
            name = f"{variable}_{hour}.grib2"
            (folder / name).write_bytes(payload(variable, hour))
            (folder / f"{name}.json").write_text(manifest(f"{variable}{hour}", variable, hour, folder / name))
    (folder / "half.grib2.json").write_text('{\n  "file_id": "half",\n  "vari')
    (folder / "gone.grib2.json").write_text(manifest("gone", "t2m", 0, folder / "gone.grib2"))
    (folder / "short.grib2").write_bytes(payload("t2m", 1)[:-7])
    (folder / "short.grib2.json").write_text(manifest("short", "t2m", 1, folder / "short.grib2"))
    (folder / "empty.grib2").write_bytes(b"")
    return folder
