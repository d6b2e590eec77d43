"""Files on disk to reports, in one go."""

import numpy as np

from wavemill.plans import jobs
from wavemill.sources import edf
from wavemill.sources.tabular import read_csv

RATE, TRIALS, SECONDS = 250, 10, 12


def write_recording(path, strong: bool, seed: int):
    """Ten trials; movement and rest differ in which side carries a 10 Hz rhythm."""
    rng = np.random.RandomState(seed)
    n = TRIALS * SECONDS * RATE
    t = np.arange(n) / RATE
    moving = np.arange(n) // (SECONDS * RATE) % 2 == 0
    gain = 2.0 if strong else 0.0
    signals = {
        "C3": 0.3 * rng.randn(n) + gain * moving * np.sin(2 * np.pi * 10 * t),
        "C4": 0.3 * rng.randn(n) + gain * ~moving * np.sin(2 * np.pi * 10 * t + 1),
        "EXTRA": rng.randn(n),
    }
    notes = [(float(i * SECONDS), 10.0, "movement" if i % 2 == 0 else "rest") for i in range(TRIALS)]
    path.write_bytes(edf.encode(signals, notes, RATE, -10, 10))


def test_bulk(spark, tmp_path):
    folders = []
    for i, who in enumerate(("data_b", "data_s")):
        folder = tmp_path / who
        folder.mkdir()
        folders.append(str(folder))
        write_recording(folder / "2023-02-23T11-57-30_real_text.edf", True, i)
        write_recording(folder / "2023-02-23T12-57-30_imagery_text.edf", False, 10 + i)
    lake, results, out = (str(tmp_path / n) for n in ("lake", "results", "reports"))
    jobs.bulk(spark, folders, lake, results, start=9, stop=10, widths=[2, 3], n_splits=5)
    rows = spark.read.parquet(results)
    assert rows.count() == 4 * 2 * 2 * 5 and rows.filter("error IS NOT NULL").isEmpty()
    jobs.write_reports(spark, results, out, "2023-02-24")
    best = read_csv(spark, f"{out}/best", "participant string, task string, classifier string, accuracy double")
    got = {(r.participant, r.task, r.classifier): r.accuracy for r in best.collect()}
    assert len(got) == 8
    for (_, task, _), accuracy in got.items():
        assert accuracy == 1.0 if task == "real_text" else accuracy < 0.9
    family = read_csv(spark, f"{out}/by_family", "participant string, type string, accuracy double")
    assert sorted((r.participant, r.type) for r in family.collect()) == [
        ("data_b", "imagery"), ("data_b", "real"), ("data_s", "imagery"), ("data_s", "real"),
    ]
    assert read_csv(spark, f"{out}/difference", "participant string, task string, diff double").count() == 4
