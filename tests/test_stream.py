import uuid

from fleetlens.operators.status import run_status
from fleetlens.session import ensure_checkpoint_dir
from fleetlens.sources.run_files import scan_run_files
from fleetlens.sources.text import scan_log_lines
from fleetlens.streaming.live_status import latest_states, stream_log_lines, stream_run_status, write_states


def test_state_follows_arriving_logs(spark, tmp_path):
    logs = tmp_path / "logs"
    for run in ("a", "b"):
        (logs / run).mkdir(parents=True)
    (logs / "a" / "ADCIRC_X_1.out.log").write_text("10% COMPLETE\n")
    (logs / "b" / "ADCIRC_X_1.out.log").write_text("20% COMPLETE\n")
    folder = f"{ensure_checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    query = write_states(stream_run_status(stream_log_lines(spark, str(logs), max_files=1)), folder).start()
    try:
        query.processAllAvailable()
        state = lambda: {r.run_path[-1]: (r.progress, r.status) for r in latest_states(spark, folder).collect()}
        assert state() == {"a": (10.0, "running"), "b": (20.0, "running")}
        (logs / "a" / "ADCIRC_SETUP_1.out.log").write_text("End Epilogue\n")
        (logs / "b" / "ADCIRC_X_1.err.log").write_text("srun: task 0\n")
        query.processAllAvailable()
        # the setup's end mark does not end the run
        assert state() == {"a": (10.0, "running"), "b": (20.0, "error")}
        (logs / "a" / "ADCIRC_Y_1.out.log").write_text("55% COMPLETE\nEnd Epilogue\n")
        query.processAllAvailable()
        assert state()["a"] == (10.0, "running")
    finally:
        query.stop()


def test_stream_agrees_with_the_batch_report(spark, tmp_path):
    logs = {
        "done": {"ADCIRC_SETUP_d.out.log": "End Epilogue\n", "ADCIRC_COLDSTART_d.out.log": "99.5% COMPLETE\n100.0% COMPLETE\nEnd Epilogue\n"},
        "half": {"ADCIRC_SETUP_h.out.log": "End Epilogue\n", "ADCIRC_COLDSTART_h.out.log": "50.5% COMPLETE\n"},
        "wave": {"SCHISM_COLDSTART_w.out.log": "x\n", "outputs/mirror.out": " time stepping begins...   1   800\nTIME STEP= 100; x\nTIME STEP= 300; x\n"},
    }
    for run, files in logs.items():
        (tmp_path / run / "outputs").mkdir(parents=True)
        markers = ("hgrid.gr3", "vgrid.in", "param.nml", "bctides.in") if run == "wave" else ("fort.14", "fort.15", "fort.16")
        for name, text in {**dict.fromkeys(markers, "x"), **files}.items():
            (tmp_path / run / name).write_text(text)
    folder = f"{ensure_checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    write_states(stream_run_status(stream_log_lines(spark, str(tmp_path))), folder).trigger(availableNow=True).start().awaitTermination()
    live = {(r.run_path, r.model, r.status, r.progress) for r in latest_states(spark, folder).collect()}
    batch = run_status(scan_run_files(spark, [str(tmp_path)]), scan_log_lines(spark, [str(tmp_path)]))
    assert live == {(r.run_path, r.model, r.status, r.progress) for r in batch.collect()}
    assert {(p.split("/")[-1], s, n) for p, _, s, n in live} == {("done", "completed", 100.0), ("half", "running", 50.5), ("wave", "running", 37.5)}
