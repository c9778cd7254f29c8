"""Arrow data sets and split JSON documents against plain readers."""

import json
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspan.sources.datasets import saved
from veilspan.sources.arrow_files import BATCH_BYTES, arrow_dataset, messages, runs, save_arrow_dataset, split_folder

TABLE = pa.table(
    {
        "id": pa.array(range(1000), pa.int64()),
        "tokens": pa.array([["é🙂"] * (k % 4) if k % 5 else None for k in range(1000)], pa.list_(pa.string())),
        "text": pa.array([f"text {k}" * (k % 30) if k % 7 else None for k in range(1000)], pa.large_string()),
        "mask": pa.array([{"value": str(k), "start": k} for k in range(1000)], pa.struct([("value", pa.string()), ("start", pa.int32())])),
    }
)


def written(path, table=TABLE, size=100, stream=True):
    path.parent.mkdir(parents=True, exist_ok=True)
    new = pa.ipc.new_stream if stream else pa.ipc.new_file
    with new(str(path), table.schema) as out:
        for batch in table.combine_chunks().to_batches(size):
            out.write_batch(batch)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def dataset(tmp_path):
    """As data sets are saved: a folder a split, files in the order that the state file gives."""
    for name in ("validation", "train"):
        for k in range(2):
            written(tmp_path / name / f"data-{k:05d}-of-00002.arrow", TABLE.slice(500 * k, 500) if name == "train" else TABLE.slice(0, 3))
        (tmp_path / name / "state.json").write_text(json.dumps({"_data_files": [{"filename": f"data-{k:05d}-of-00002.arrow"} for k in range(2)]}))
        written(tmp_path / name / "data-left-behind.arrow", TABLE.slice(0, 1))
    (tmp_path / "dataset_dict.json").write_text(json.dumps({"splits": ["validation", "train"]}))
    return tmp_path


def test_an_arrow_data_set_equals_its_parquet_copy(spark, dataset, tmp_path_factory):
    import pyarrow.parquet as pq

    copy = tmp_path_factory.mktemp("copy") / "x.parquet"
    pq.write_table(TABLE, copy)
    parquet = spark.read.parquet(str(copy))
    got = arrow_dataset(spark, str(dataset))
    assert got.schema.simpleString() == parquet.schema.simpleString() and rows(got) == rows(parquet)
    assert rows(arrow_dataset(spark, f"file://{dataset}", "text string, id int")) == rows(parquet.select("text", F.col("id").cast("int")))
    assert arrow_dataset(spark, str(dataset), split="validation").count() == 6
    assert arrow_dataset(spark, str(dataset / "train"), "id long").count() == 1000  # a split's own folder
    assert saved(spark, str(dataset)).count() == 1000 and saved(spark, str(dataset), "validation").count() == 6
    with pytest.raises(Exception, match="no split"):
        arrow_dataset(spark, str(dataset), split="test")
    with pytest.raises(Exception, match="no column"):
        arrow_dataset(spark, str(dataset), "other string").collect()


@pytest.mark.parametrize("stream", [True, False])
def test_a_partition_is_a_run_of_batches(spark, tmp_path, stream):
    written(tmp_path / "a.arrow", stream=stream)
    written(tmp_path / "b.arrow", size=1000, stream=stream)
    found = runs(str(tmp_path), 1)
    assert len(found) == 11  # ten batches and one
    assert len(runs(str(tmp_path), BATCH_BYTES)) == 2
    got = arrow_dataset(spark, str(tmp_path), "id long", batch_bytes=1)
    assert got.rdd.getNumPartitions() == 11
    assert sorted(r.id for r in got.collect()) == sorted([*range(1000)] * 2)
    assert {r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()} == {100, 1000}


def test_no_file_is_read_whole_to_be_split(tmp_path):
    written(tmp_path / "a.arrow", TABLE)

    read = 0
    with pa.OSFile(str(tmp_path / "a.arrow")) as source:

        class Seen:
            def size(self):
                return source.size()

            def seek(self, at):
                source.seek(at)

            def read(self, n):
                nonlocal read
                read += n
                return source.read(n)

        found = list(messages(Seen()))
        bodies = sum(size for kind, _, size in found if kind == 3)
        assert [k for k, _, _ in found] == [1] + [3] * 10
        assert read < source.size() - bodies / 2


def test_dictionaries_and_older_streams(spark, tmp_path):
    table = pa.table({"k": pa.array(["a", "b", None, "a"]).dictionary_encode(), "n": [1, 2, 3, 4]})
    for stream in (True, False):
        written(tmp_path / f"{stream}" / "x.arrow", table, 2, stream)
        assert rows(arrow_dataset(spark, str(tmp_path / f"{stream}"))) == rows(spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "k string, n long"))
    (tmp_path / "old").mkdir()
    with pa.ipc.new_stream(str(tmp_path / "old" / "x.arrow"), TABLE.schema, options=pa.ipc.IpcWriteOptions(use_legacy_format=True)) as out:
        out.write_table(TABLE, 300)
    assert struct.unpack("<I", (tmp_path / "old" / "x.arrow").read_bytes()[:4])[0] != 0xFFFFFFFF
    assert sorted(r.id for r in arrow_dataset(spark, str(tmp_path / "old"), "id long", batch_bytes=1).collect()) == [*range(1000)]


def test_saved_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([(k, f"é{k}" if k % 3 else None, [k] * (k % 3)) for k in range(50)], "id long, t string, v array<int>").repartition(3)
    path = str(tmp_path / "set")
    save_arrow_dataset(df, path, "validation")
    save_arrow_dataset(df.where("id < 7"), path, "train")
    assert rows(arrow_dataset(spark, path)) == rows(df.where("id < 7")) and rows(arrow_dataset(spark, path, split="validation")) == rows(df)
    save_arrow_dataset(df.where("id > 40"), path, "train", mode="append")
    assert rows(arrow_dataset(spark, path)) == rows(df.where("id < 7 or id > 40"))
    save_arrow_dataset(df.where("id < 0"), path, "train")
    assert arrow_dataset(spark, path).schema.simpleString() == df.schema.simpleString() and arrow_dataset(spark, path).collect() == []
    assert split_folder(path).endswith("/train") and len(list((tmp_path / "set" / "train").glob("*.arrow"))) == 1


NASTY = [
    {"text": 'a "quoted" [x] {y}, \\', "n": 1, "deep": {"a": [1, {"b": "}]"}], "c": "\\\\"}},
    {"text": "\\\\\\" + '"', "n": 2, "deep": {"a": [], "c": "é🙂\u2028"}},
    {"text": "", "n": None, "deep": None},
    {"text": "},{", "n": 4, "deep": {"a": [[1, [2]], "x"], "c": ']}"'}},
]


@pytest.mark.parametrize("dump", [{}, {"indent": 1}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_a_document_cut_at_every_byte(dump):
    from veilspan.sources.json_documents import NOTHING, OUT, Elements, followed, summary

    array = json.dumps(NASTY, **dump).encode()
    parts = json.dumps({"meta": {"a": [1, 2], "b": "x"}, "validation": NASTY[:2], "train": NASTY, "empty": [], "n": 3}, **dump).encode()
    for data, target, part in ((array, 1, None), (parts, 2, b"train")):
        for cut in range(len(data) + 1):
            left, right = data[:cut], data[cut:]
            if part and not left.endswith(b"}"):  # blocks begin after a brace, and so never within a key
                continue
            assert followed(summary(left), summary(right))[OUT] == summary(data)[OUT] and followed(NOTHING, summary(left)) == summary(left)
            one = Elements(OUT, 0, target, part, None)
            found = [x for x in one.feed(left)]
            head = one.left()
            mode, depth = summary(left)[OUT]
            assert (one.mode, one.depth) == (mode, depth)
            two = Elements(mode, depth, target, part, one.opened)
            for whole, text in two.feed(right):
                found.append((True, text if whole else (head or b"") + text))
                head = None if not whole else head
            assert [json.loads(t) for whole, t in found if t.strip()] == NASTY, (cut, part)
            again = Elements(OUT, 0, target, part, None)  # the same in two batches of one block
            assert [json.loads(t) for x in (left, right) for _, t in again.feed(x) if t.strip()] == NASTY


@pytest.mark.parametrize("width", [31, 400])
def test_json_documents_in_blocks(spark, tmp_path, width):
    from veilspan.sources.datasets import json_document

    schema = "text string, n long, deep struct<a: string, c: string>"
    (tmp_path / "array.json").write_text("\n " + json.dumps(NASTY * 3, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "parts.json").write_text(json.dumps({"validation": NASTY[1:], "meta": {"x": [1]}, "train": NASTY * 2}, indent=2) + "\n")
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "numbers.json").write_text('{"train": [], "other": [{"text": "x"}]}')
    keys = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, str(width))
        for name, expected in (("array", NASTY * 3), ("parts", NASTY * 2), ("empty", []), ("numbers", [])):
            text = [json.dumps(x) for x in expected]
            wanted = spark.createDataFrame([(t,) for t in text], "v string").select(F.from_json("v", schema).alias("r")).select("r.*")
            assert rows(json_document(spark, str(tmp_path / f"{name}.json"), schema)) == rows(wanted), name
        assert json_document(spark, str(tmp_path / "parts.json"), schema, "validation").count() == 3
        assert json_document(spark, str(tmp_path / "parts.json"), schema, "absent").count() == 0
        assert json_document(spark, [str(tmp_path / "array.json"), str(tmp_path / "parts.json")], schema).count() == 5 * len(NASTY)
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def test_json_arrays_written_by_all_tasks(spark, tmp_path):
    from veilspan.sources.json_documents import json_elements, write_json_arrays

    df = spark.createDataFrame([(k, 'x"}],[{' * (k % 3) + "\n") for k in range(30)], "id long, t string").repartition(4)
    write_json_arrays(df, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) == 4 and sorted(r["id"] for f in files for r in json.loads(f.read_text())) == [*range(30)]
    assert sorted(json.loads(r.value)["id"] for r in json_elements(spark, str(tmp_path / "out")).collect()) == [*range(30)]
    write_json_arrays(df.where("id < 0").coalesce(1), str(tmp_path / "none"))
    assert json_elements(spark, str(tmp_path / "none")).collect() == []


def test_json_blocks_come_in_bounded_runs():
    """A batch of many bytes, or a row of many, is scanned a bounded part at a time."""
    import pyarrow as pa

    from veilspan.functions.batches import SLICE_BYTES
    from veilspan.sources.json_documents import _blocks, _lines, _summaries, followed, NOTHING, summary

    values = ['{"a": "' + "é\\\\" * 100_000 + '"', *(f', {{"a": "{"y" * 3_000}"' for _ in range(2_000)), "", "]"]
    n = len(values)
    batch = pa.record_batch({"file": ["f"] * n, "block": pa.array([0] * (n - 2) + [9] * 2, pa.int64()), "value": pa.array(values, pa.string())})
    runs = list(_blocks(iter([batch])))
    assert max(len(data) for _, data in runs) <= SLICE_BYTES and len(runs) > 5
    whole = {b: b"".join(v.encode() + b"}" for v, k in zip(values, batch.column("block").to_pylist(), strict=True) if k == b) for b in (0, 9)}
    assert {b: b"".join(d for k, d in runs if k == ("f", b)) for b in (0, 9)} == whole
    got = pa.Table.from_batches(list(_summaries(iter([batch])))).to_pylist()
    assert {r["block"]: r["summary"] for r in got} == {b: [x for pair in followed(NOTHING, summary(data)) for x in pair] for b, data in whole.items()}
    lines = list(_lines(iter([batch])))
    assert max(x.nbytes for x in lines) <= 2 * SLICE_BYTES
    assert "\n".join(v for x in lines for v in x.column("value").to_pylist()) == "[" + "\n,".join(values) + "\n]"
