from datetime import datetime, timedelta

from abridge.api import summarize
from abridge.config import Config
from abridge.streaming.sets import summarize_sets

T0 = datetime(2024, 1, 1)
CONFIG = Config(length=2, unit="SENTENCES")
SHAPE = "conv long, at timestamp, pos long, text string"


def _at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_sets_over_three_batches_are_summarised_once_whole(spark, tmp_path):
    says = [f"Speaker {k} saw the small town in heavy rain today. Then {k} cats ran over the wide road home." for k in range(9)]
    batches = [
        [(1, _at(0), 0, says[0]), (2, _at(1), 0, says[1]), (1, _at(5), 1, says[2])],
        [(2, _at(9), 1, says[3]), (1, _at(3), 2, says[4]), (3, _at(80), 0, says[5])],  # out of order, and time goes on
        [(1, _at(7), 3, "Too late for this one at all events."), (3, _at(85), 1, says[6]), (2, _at(200), 0, says[7]), (None, _at(200), 0, says[8])],
        [(99, _at(2000), 0, "A long time later all is quiet.")],
        [(99, _at(2001), 0, "And nothing more is said here.")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    got, late = {}, []

    def sink(summaries, rows, epoch):
        for r in summaries.collect():
            got.setdefault(r.set_id, []).append(r.summary)
        late.extend((r.set_id, r.text) for r in rows.collect())

    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    query = summarize_sets(stream, sink, str(tmp_path / "state"), CONFIG, trigger={"availableNow": True}, set_col="conv", delay=timedelta(minutes=10), gap=timedelta(minutes=30), grace=timedelta(hours=3))
    assert query.awaitTermination(240)
    assert late == [(1, "Too late for this one at all events.")]
    whole = spark.createDataFrame([(1, 0, says[0]), (1, 1, says[4]), (1, 2, says[2]), (2, 0, says[1]), (2, 1, says[3]), (3, 0, says[5]), (3, 1, says[6]), (4, 0, says[7])], "set_id long, pos long, text string")
    want = {r.set_id: r.summary for r in summarize(whole, CONFIG, "set_id", "text", "pos").collect()}
    assert got == {1: [want[1]], 2: [want[2], want[4]], 3: [want[3]]}  # set 2 spoke again after a long silence
