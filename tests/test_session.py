"""Session helpers, the benchmark and the driver's entry."""

import json
import os

import pytest

from tarnsearch import session


def test_scratch_removes_what_was_written_inside(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file:{tmp_path}/shared")
    kept = session.write_shared(spark.range(3), "kept")
    with session.scratch(spark):
        inside = session.write_shared(spark.range(5), "inside")
        assert inside.count() == 5 and len([n for n in os.listdir(tmp_path / "shared") if not n.startswith(".")]) == 2
    assert [n.split("-")[0] for n in os.listdir(tmp_path / "shared") if not n.startswith(".")] == ["kept"] and kept.count() == 3


def test_a_cluster_has_to_name_its_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs:/x"}
    assert session.shared_dir(Session()) == "hdfs:/x"


def test_bench_prints_one_line_with_rates(spark, data, monkeypatch, capsys):
    import bench

    monkeypatch.setenv("BENCH_SF_DIR", data)
    monkeypatch.setenv("BENCH_QUERIES", "postings_positions,batch_search,pagerank_links")
    monkeypatch.setattr(bench, "local_session", lambda **_: spark)
    bench.main()
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert set(out["queries"]) == {"index_build", "postings_positions", "batch_search", "pagerank_links"} and out["rates"]["index_mib_per_s"] > 0 and out["unit"] == "sec"


def test_a_broken_optional_module_is_not_hidden(tmp_path, monkeypatch):
    import __spark_entry__ as e

    (tmp_path / "oddmod").mkdir()
    (tmp_path / "oddmod" / "__init__.py").write_text("")
    (tmp_path / "oddmod" / "queries.py").write_text("import no_such_module_at_all")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        e._optional("oddmod.queries")
    assert e._optional("oddmod.absent") is None and e._optional("nowhere_at_all.queries") is None
