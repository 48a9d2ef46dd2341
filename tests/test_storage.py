"""Outputs and the audit log on the cluster's storage."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from tidewatch.sources import records, storage


def event(i):
    return records.AuditEvent("written", "tester", f"file-{i}", "0" * 64, created_at=f"2026-01-01T00:00:{i:02}+00:00", details={"n": "x" * 500})


@pytest.mark.parametrize("scheme", [True, False])
def test_writers_at_once_lose_no_event(spark, tmp_path, scheme):
    log = (tmp_path / "log").as_uri() if scheme else tmp_path / "log.jsonl"
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: records.append_event(log, event(i), spark), range(40)))
    found = records.read_log(log, spark)
    assert sorted(e["artifact"] for e in found) == sorted(f"file-{i}" for i in range(40))
    assert records.log_frame(spark, str(log)).filter("event_type = 'written'").count() == 40
    if scheme:
        assert [e["created_at"] for e in found] == sorted(e["created_at"] for e in found)
        with pytest.raises(ValueError):
            records.append_event(log, event(1))


def test_a_log_that_is_not_there_is_empty(spark, tmp_path):
    assert records.read_log((tmp_path / "none").as_uri(), spark) == records.read_log(tmp_path / "none.jsonl") == ()


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_all_outputs_on_the_clusters_storage(spark, tmp_path):
    from tidewatch.plans import analysis
    from tidewatch.plans import monitoring as m

    table = m.monitoring(spark, "/root/testdata/sf0.001").limit(600).persist()
    found = analysis.MonitoringAnalysis(table, resamples=10)
    folder, log = (tmp_path / "out").as_uri(), (tmp_path / "log").as_uri()
    paths = analysis.write_outputs(found, folder, log)
    assert set(paths) == set(analysis.OUTPUTS) and all(str(p).startswith("file:") for p in paths.values())
    assert storage.Folder(spark, folder).names() == sorted(analysis.OUTPUTS.values())
    assert [e["artifact"] for e in records.read_log(log, spark)] == [paths["json"]]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(analysis.MonitoringAnalysis, "summary_dict", property(lambda self: 1 / 0))
        with pytest.raises(ZeroDivisionError):
            analysis.write_outputs(found, f"{folder}-2")
    assert storage.Folder(spark, f"{folder}-2").names() == []


def test_texts_are_replaced_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    folder = storage.Folder(spark, tmp_path.as_uri())
    folder.write({"a.csv": "one\n", "b.csv": "zwei é\n"})
    assert folder.names() == ["a.csv", "b.csv"] and folder.read("b.csv").decode() == "zwei é\n"
    folder.write({"a.csv": "another\n"})
    assert (tmp_path / "a.csv").read_text() == "another\n"
    monkeypatch.setattr(folder, "_place", lambda staged: (_ for _ in ()).throw(OSError("no room")))
    with pytest.raises(OSError):
        folder.write({"a.csv": "third\n", "c.csv": "new\n"})
    assert folder.names() == ["a.csv", "b.csv"] and (tmp_path / "a.csv").read_text() == "another\n"
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    assert storage.is_uri("s3a://bucket/x") and storage.is_uri("file:/x") and not storage.is_uri("/x") and not storage.is_uri("out")
