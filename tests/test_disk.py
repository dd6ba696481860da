"""What the steps of the reconciliation write."""

import gc
import os
import time

from ledgerloom import steps
from ledgerloom.operators import reconcile as rc

from test_reconcile import numbered, tables


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_of_a_step_go_at_its_end(spark):
    """Not when the driver happens to collect its garbage: all steps of a reconciliation would be on disk at once."""
    gc.disable()
    try:
        before, setting = shuffle_files(spark), spark.conf.get(steps.CLEANUP)
        tx = numbered([(f"T{i}", f"R{i}" if i % 3 else None, "Ann", "Bob", 10.0 + i, "USD") for i in range(60)])
        bank = numbered([(f"B{i}", f"R{i}", "Ann", 10.0 + i, "USD") for i in range(60)])
        out = rc.reconcile(*tables(spark, tx, bank, []))
        for _ in range(100):  # they are removed in the background
            if not (left := shuffle_files(spark) - before):
                break
            time.sleep(0.1)
        assert not left and spark.conf.get(steps.CLEANUP) == setting
        assert out.where("match_confidence >= 90").count() == 40
    finally:
        gc.enable()


def small(spark):
    tx = numbered([(f"T{i}", f"R{i % 50}" if i % 3 else None, "Ann", "Bob", 10.0 + i, "USD") for i in range(60)])
    bank = numbered([(f"B{i}", f"R{i}", "Ann" if i % 5 else "Bo", 10.0 + i, "USD") for i in range(55)])
    return tables(spark, tx, bank, numbered([(f"E{i}", f"R{i}", "Bob", 9.0 + i, "USD") for i in range(20)]))


def test_large_tables_are_taken_in_slices(spark, monkeypatch):
    """Each reference is in one of them, so shuffle files of a part of the tables are on disk at a time. The results are the same."""
    keys, real = [], rc.of_one_key

    def seen(tx, ledger):
        keys.append({r.key for r in tx.select("key").union(ledger.select("key")).where("key is not null").collect()})
        return real(tx, ledger)

    monkeypatch.setattr(rc, "of_one_key", seen)
    whole = sorted(map(str, rc.reconcile(*small(spark)).collect()))
    monkeypatch.setattr(steps, "SLICE", 1)
    assert sorted(map(str, rc.reconcile(*small(spark)).collect())) == whole and len(whole) == 60
    assert len(keys) == 1 + steps.SLICES and set().union(*keys[1:]) == keys[0] and sum(map(len, keys[1:])) == len(keys[0]) > 2 * max(map(len, keys[1:]))


def test_a_step_of_several_parts_is_one_table(spark):
    """Shuffle files of a part are gone before long, while the next is computed."""
    gc.disable()
    try:
        before, parts = shuffle_files(spark), [spark.range(100).where(here).repartition(3, "id") for here in steps.slices(4, "id")]
        assert sorted(r.id for r in steps.materialize(*parts, compression="zstd").collect()) == list(range(100))
        for _ in range(100):
            if not (left := shuffle_files(spark) - before):
                break
            time.sleep(0.1)
        assert not left
    finally:
        gc.enable()


def test_a_reference_with_one_transfer_comes_without_key(spark):
    """By one shuffle: its ledger rows with the transfer, or the transfer alone; where there are several, each row by itself."""
    tx = spark.createDataFrame([("a", 1, "p1", "q1", 5.0), ("b", 2, "p2", "q2", 6.0), ("c", 3, "p3", "q3", 7.0), ("c", 4, "p4", "q4", 8.0), (None, 5, "p5", "q5", 9.0)], "key string, seq long, payer string, payee string, usd double")
    ledger = spark.createDataFrame([("a", "BANK", 1, "B1", "n1", 1.0), ("a", "ERP", 1, "E1", "n2", 2.0), ("c", "BANK", 2, "B2", "n3", 3.0), ("d", "ERP", 2, "E2", "n4", 4.0), (None, "ERP", 3, "E3", "n5", 5.0)], "key string, side string, l_seq long, ledger_id string, name string, l_usd double")
    rows = rc.of_one_key(tx, ledger)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    none = (None,) * 5
    assert {tuple(r) for r in rows.collect()} == {
        (None, 1, "p1", "q1", 5.0, "BANK", 1, "B1", "n1", 1.0), (None, 1, "p1", "q1", 5.0, "ERP", 1, "E1", "n2", 2.0), (None, 2, "p2", "q2", 6.0, *none),
        ("c", 3, "p3", "q3", 7.0, *none), ("c", 4, "p4", "q4", 8.0, *none), ("c", None, None, None, None, "BANK", 2, "B2", "n3", 3.0),
    }


def test_a_ledger_row_comes_to_the_search_once(spark, monkeypatch):
    """However different the amounts are that transfers may be off by; of blocks that none asks for, hardly a row comes."""
    seen = []
    monkeypatch.setattr(rc, "nearest", lambda rows, parts: seen.append([tuple(r) for r in rows.select("side", "name", "kind", "seq").collect()]))
    ledger = spark.createDataFrame([("BANK", i, f"L{i}", "ann" if i % 2 else "bob", 10.0 + i, None) for i in range(400)], "side string, l_seq long, ledger_id string, name string, l_usd double, taken_at long")
    # amounts may be off by nothing, by 2, 30 and 90 of 100, and by anything
    able = spark.createDataFrame([(i, "BANK", "ann", 60.0, reach, 100.0, "ann", "x") for i, reach in enumerate((63.99, 63.2, 52.0, 28.0, -0.011))], "seq long, side string, name string, score double, reach double, usd double, payer string, payee string")
    rc.in_blocks(able, None, ledger, 2)
    held, asked = ([r for r in seen[0] if r[2] == kind] for kind in (0, 1))
    assert {r[3] for r in held} >= {i for i in range(400) if i % 2} and len(held) < 210 and {r[3] for r in asked} == set(range(5))


def test_steps_that_are_read_no_more_are_removed(spark):
    step = steps.materialize(spark.range(5))
    folder = steps.written()[-1]
    assert sorted(r.id for r in step.collect()) == list(range(5))
    steps.forget(step)
    assert folder not in steps.written() and not os.path.exists(folder.removeprefix("file:"))


def test_messages_that_no_listener_waits_for_are_not_kept(spark, tmp_path):
    """They move the watermark all the same: the last one, of another method, tells the second listener that nothing came."""
    from ledgerloom.streaming import feeds

    at = lambda s: f"timestamp_seconds({1_700_000_000 + s})"
    spark.sql(f"select * from values (1L, 'put', '/a', {at(0)}), (2L, 'put', '/b', {at(1)}) as t(listener, method, path, ts)").write.parquet(f"{tmp_path}/asked")
    spark.sql(f"select id as seq, if(id = 70, 'put', 'get') as method, '/a' as path, if(id = 99, {at(9000)}, timestamp_seconds(1700000000 + id % 9)) as ts from range(100)").write.parquet(f"{tmp_path}/heard")
    kept = {}
    for methods in (None, ("put",)):
        asked, heard = (spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{x}").schema).parquet(f"{tmp_path}/{x}") for x in ("asked", "heard"))
        out = feeds.await_callbacks(asked, heard, methods=methods)
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out{methods}").option("checkpointLocation", f"{tmp_path}/cp{methods}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out{methods}").collect()} == {(1, 70), (2, None)}
        kept[methods] = sum(o.numRowsUpdated for p in q.recentProgress for o in p.stateOperators if "Join" in o.operatorName)
    assert kept[("put",)] <= 3 < 50 < kept[None]
