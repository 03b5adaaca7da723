from cases import ODD, frame

from weftwork.llm import compaction


def rows_of(df):
    return sorted(map(str, df.select("doc_id", "text", "n").collect()))


def test_arrivals_merge_by_tiers(spark, tmp_path):
    table = compaction.ShardedTable(spark, f"file://{tmp_path}/t", fan_in=3, target_bytes=1 << 20, smallest=1 << 10)
    docs = frame(spark, ODD)
    for turn in range(9):
        table.append(docs)
        table.compact()
    assert rows_of(table.read()) == sorted(rows_of(docs) * 9)
    manifest = table.manifest()
    tiers = [table.tier(r["bytes"]) for r in manifest["runs"]]
    assert all(tiers.count(t) < 3 for t in tiers)
    folders = {n for n, _ in table.store.names("") if n.startswith("run-")}
    assert folders == {r["run"] for r in manifest["runs"]}


def test_writers_do_not_overwrite_each_other(spark, tmp_path):
    one = compaction.ShardedTable(spark, f"file://{tmp_path}/t")
    two = compaction.ShardedTable(spark, f"file://{tmp_path}/t")
    assert one.store.publish("_manifests/v000000000001.json", '{"version": 1, "schema": null, "runs": []}')
    assert not two.store.publish("_manifests/v000000000001.json", "{}")
    docs = frame(spark, ODD)
    real, taken = one.manifest, []

    def late(version=None):
        found = real(version)
        if not taken:
            taken.append(1)
            two.append(docs)  # comes between reading the newest version and publishing the next
        return found

    one.manifest = late
    one.append(docs)
    assert two.version() == 3 and rows_of(two.read()) == sorted(rows_of(docs) * 2)
    assert rows_of(two.read(2)) == rows_of(docs)


def test_empty_table_and_other_columns(spark, tmp_path):
    table = compaction.ShardedTable(spark, f"file://{tmp_path}/t")
    assert table.version() == 0 and table.compact() == 0
    table.append(frame(spark, []))
    assert table.read().collect() == []
    try:
        table.append(spark.range(3))
    except ValueError:
        pass
    else:
        raise AssertionError("other columns were taken")
    assert table.version() == 1
