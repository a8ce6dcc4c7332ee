from tallymill import plans
from tallymill.plans import streams
from tallymill.streaming import live


def test_state_of_all_lines_is_on_disk(spark, tmp_path, monkeypatch):
    before = {k: spark.conf.get(k, None) for k in live.ON_DISK}
    monkeypatch.setattr(streams, "scratch_path", lambda _: str(tmp_path))
    assert plans.QUERIES["live_progress_stream"](spark, "/root/testdata/sf0.001").count()
    assert list(tmp_path.glob("state/state/**/*.changelog")) and not list(tmp_path.glob("state/state/**/*.delta"))
    assert {k: spark.conf.get(k, None) for k in live.ON_DISK} == before
