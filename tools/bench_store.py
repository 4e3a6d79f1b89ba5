"""Open a store of full-size grids and read one cell, a box and an ensemble mean.

    python tools/bench_store.py [valid times, default 100]

Members 50, grid 361 x 720, one variable, one partition per time. Values are constant,
so the files are small on disk; readers still decode every value of the rows they touch.

Measured on local[8], 100 times, second of two rounds (seconds):

    open                     0.263
    one cell                 0.239
    box 50 x 100             0.356
    one step                 0.192
    ensemble mean, cells     3.479
    ensemble mean, blocks    1.183
    all times, one cell      4.807
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridspark import runtime  # noqa: E402
from gridspark.functions.axes import StepAxis  # noqa: E402
from gridspark.operators import selection, stats, store  # noqa: E402
from gridspark.sources import synth  # noqa: E402


def main() -> None:
    times = int(sys.argv[1]) if len(sys.argv) > 1 else 100
    spark = runtime.session("bench-store", master="local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false",
                            spark_driver_memory="8g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    path = runtime.new_dir(spark, "full-grids")
    last = times - 1
    spec = store.StoreSpec(variables=("t2m",), axis=StepAxis(last, last, last))
    store.save(synth.generate_cycles(spark, "2024-01-01", spec, num_days=1, cycle_hours=24, fill=280.0), path)

    def timed(label, run):
        started = time.perf_counter()
        run()
        print(f"{label:24s} {time.perf_counter() - started:.3f}", flush=True)

    noop = {"format": "noop", "mode": "overwrite"}
    for _ in range(2):
        timed("open", lambda: store.open_store(spark, path))
        fields = store.open_store(spark, path)
        one = selection.step(fields, "t2m", last)
        timed("one cell", lambda: selection.point(one).select("value").collect())
        timed("box 50 x 100", lambda: selection.box(one, slice(150, 200), slice(300, 400)).write.save(**noop))
        timed("one step", lambda: one.write.save(**noop))
        timed("ensemble mean, cells", lambda: stats.ensemble_mean(one).write.save(**noop))
        timed("ensemble mean, blocks", lambda: stats.ensemble_mean_blocks(one).write.save(**noop))
        timed("all times, one cell", lambda: selection.point(fields).select("value").write.save(**noop))


if __name__ == "__main__":
    main()
