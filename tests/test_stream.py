from hashgrove.operators import refs
from hashgrove.sources.fixtures import fixture
from hashgrove.streaming.refs import apply_stream


def test_stream_replay_equals_batch(spark, sf, tmp_path):
    commands = fixture(spark, sf, "fx_commands").select("repo_id", "name", "pos", "old_oid", "new_oid")
    commands.where("pos < 400").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    commands.where("pos >= 400").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(commands.schema).parquet(f"{tmp_path}/in/a")
    out = apply_stream(stream).writeStream.format("memory").queryName("replayed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    out.awaitTermination()
    got = sorted((r.repo_id, r.name, r.pos, r.reason) for r in spark.table("replayed").collect())
    want = sorted((r.repo_id, r.name, r.pos, r.reason) for r in refs.replay(commands.where("pos < 400")).collect())
    assert [(*x[:3], str(x[3])) for x in got] == [(*x[:3], str(x[3])) for x in want] and got
