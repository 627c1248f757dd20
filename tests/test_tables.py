import dataclasses
import json

import pyarrow.parquet as pq
import pytest

from quillon.functions import documents as D
from quillon.functions.schemas import Field, SchemaError, describe, flat_fields, leaves, nested_fields, shape
from quillon.operators import tables as T
from quillon.sources.documents import read_documents, stored_bytes, write_parquet
from quillon.sources.storage import shared_dir
from quillon.streaming.incremental import stream_to_parquet


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, doc string")


@pytest.mark.parametrize("text,want,rows", [
    ('[{"port":80,"host":"ox"},{"port":81,"host":"elk"}]', [("port", "int64", False), ("host", "string", False)], [(80, "ox"), (81, "elk")]),
    ('[{"port":80,"load":4},{"port":81},{"load":null,"port":82}]', [("port", "int64", False), ("load", "int64", True)], [(80, 4), (81, None), (82, None)]),
    ('[{"load":0.25},{"load":3}]', [("load", "double", False)], [(0.25,), (3.0,)]),
    ('[{"tag":false},{"tag":"ox"},{"tag":6}]', [("tag", "json", False)], [("false",), ('"ox"',), ("6",)]),
    ('[{"disk":{}},{"disk":{"gb":9}}]', [("disk", "json", False)], [("{}",), ('{"gb":9}',)]),
    ("[7,8]", [("value", "int64", False)], [(7,), (8,)]),
    ('{"host":"ox","up":true}', [("host", "string", False), ("up", "boolean", False)], [("ox", True)]),
    ('"ox"', [("value", "string", False)], [("ox",)]),
    ("[]", [("value", "string", False)], []),
    ('["ox",{"port":80}]', [("value", "json", False)], [('"ox"',), ('{"port":80}',)]),
])
def test_flat(spark, text, want, rows):
    df = docs(spark, text)
    found = T.infer_flat(df, "doc")
    assert [(f.name, f.kind, f.nullable) for f in found] == want
    assert [tuple(r) for r in T.shred(df, "doc", found).collect()] == rows


def test_order_is_of_first_appearance_by_the_ordinal(spark):
    df = docs(spark, '{"zinc":1}', None, "~~", '{"boron":1,"zinc":2}', '{"argon":1}')
    shuffled = df.repartition(3, "doc").sort(df.id.desc())
    assert [f.name for f in T.infer_flat(shuffled, "doc", ordinal="id")] == ["zinc", "boron", "argon"]
    assert [f.name for f in T.infer_nested(shuffled, "doc", ordinal="id")] == ["zinc", "boron", "argon"]


def test_nested(spark):
    df = docs(spark, '[{"host":"ox","disk":{},"ports":[{"no":80},{"no":80.5,"open":["tcp"]}],"odd":"x"},{"host":"elk","note":"3","ports":[],"odd":{"a":1}}]')
    found = T.infer_nested(df, "doc")
    assert describe(found) == ["host: string", "disk: string optional", "ports: list", "  element: group optional", "    no: double", "    open: list optional", "      element: string optional", "odd: json", "note: string optional"]
    rows = T.shred(df, "doc", found, nested=True).collect()
    assert rows[0]["ports"][1].asDict(True) == {"no": 80.5, "open": ["tcp"]} and rows[0]["ports"][0]["no"] == 80.0
    assert rows[1]["ports"] == [] and rows[0]["disk"] is None and rows[1]["odd"] == '{"a":1}'


def test_levels():
    open_ = Field("open", "list", True, (Field("element", "string", True),))
    assert leaves([Field("no", "int64"), open_]) == [("no", 0, 0), ("open.list.element", 3, 1)]
    disk = Field("disk", "group", True, (Field("make", "string", True), Field("sizes", "list", False, (Field("element", "int64", True),))))
    assert leaves([disk]) == [("disk.make", 2, 0), ("disk.sizes.list.element", 3, 1)]


@dataclasses.dataclass
class Server:
    host: str
    port: int
    note: str | None
    backups: list["Server"]


@dataclasses.dataclass
class Ring:
    next: "Ring"


def test_class_schemas():
    assert describe(flat_fields(Server)) == ["host: string", "port: int64", "note: string optional", "backups: json"]
    assert flat_fields(bool) == [Field("value", "boolean")]
    one = nested_fields(Server, 2)[3]
    two = one.children[0].children[3]
    assert one.kind == two.kind == "list" and [f.name for f in two.children[0].children] == ["host", "port", "note"]
    with pytest.raises(SchemaError):
        nested_fields(int)
    with pytest.raises(SchemaError, match="too deep"):
        flat_fields(Ring)
    assert [shape(x) for x in (Server, list[Server], str, Server | None)] == ["record", "array", "scalar", "record"]


def test_mismatch_gives_zeros_and_empty_schema_raises(spark):
    df = docs(spark, '{"port":"x","up":3,"load":0.5,"host":null}')
    fields = [Field("port", "int64"), Field("up", "boolean"), Field("load", "int64"), Field("host", "string"), Field("gone", "double")]
    assert tuple(T.shred(df, "doc", fields).first()) == (0, True, 0, None, None)
    with pytest.raises(ValueError):
        T.shred(df, "doc", [])


def test_too_many_fields(spark):
    with pytest.raises(ValueError):
        T.infer_flat(docs(spark, json.dumps({str(i): i for i in range(20)})), "doc", max_fields=10)


def test_accessors_never_coerce(spark):
    df = docs(spark, '{"port":8,"load":0.5,"text":"8","up":false,"none":null,"rule":/q/m,"list":[8,{"no":9}]}')
    x = df.select(D.extract("doc", i=("int", "port"), wide=("double", "port"), si=("int", "text"), ds=("string", "load"), r=("string", "rule"), gone=("boolean", "gone"), sb=("boolean", "text"), k=("int", "list", 1, "no"), out=("int", "list", 7), place=("int", 0), deep=("int", "list", 1, 0)).alias("x")).first().x
    assert tuple(x) == (8, 8.0, None, None, "/q/m", False, None, 9, None, 8, 9)


def test_null_documents(spark):
    df = docs(spark, None, "~")
    got = df.select(D.parse("doc").alias("p"), D.kind(D.parse("doc")).alias("k"), D.same("doc", "doc").alias("s"), D.edit("doc", D.append(1)).alias("e"), D.contains_all(D.parse("doc"), []).alias("c"), D.count(D.parse("doc")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(None, None, None, None, False, None)] * 2


def test_write_groups_and_stream(spark, tmp_path):
    df = docs(spark, json.dumps([{"no": i, "host": None if i % 4 == 0 else str(i)} for i in range(250)])).coalesce(1)
    size = write_parquet(T.to_table(df, "doc"), str(tmp_path / "t"), rows_per_group=100)
    assert size == stored_bytes(spark, str(tmp_path / "t")) > 0
    (file,) = (tmp_path / "t").glob("*.parquet")
    assert [pq.ParquetFile(file).metadata.row_group(i).num_rows for i in range(3)] == [100, 100, 50]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text('{"host":"ox","port":3}\n[{"host":"elk","port":4},{"host":"yak"}]\n')
    stream = spark.readStream.text(str(tmp_path / "in"))
    stream_to_parquet(stream, "value", flat_fields(Server), str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True).awaitTermination(60)
    assert sorted((r.host, r.port) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("elk", 4), ("ox", 3), ("yak", None)]
    assert read_documents(spark, str(tmp_path / "in")).count() == 2


def test_no_folder_of_one_machine_on_a_cluster(spark):
    class Unset:
        """A context on a cluster, without a checkpoint folder."""

        master = "spark://x"

        def get(self, *_):
            return None

        def sc(self):
            return self

        getCheckpointDir = sc

        def isDefined(self):
            return False

    context = Unset()
    context._jsc = context.conf = context.sparkContext = context
    with pytest.raises(ValueError):
        shared_dir(context)
    assert shared_dir(spark)
