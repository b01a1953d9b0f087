import json

from docspark import cli


def lines(path, docs):
    path.write_text("\n".join(json.dumps(d) for d in docs))
    return f"file://{path}"


def test_build_ask_update_and_roll_back(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("DOCSPARK_EMBEDDING_DIM", "32")
    root = f"file://{tmp_path}/kb"

    def run(*args):
        code = cli.main([root, *args], spark)
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    about = lambda topic: f"Everything here is about {topic}. " * 12
    first = [{"document_id": "1", "title": "Rivers", "url": "https://x.org/a/rivers", "text": about("rivers and lakes")}, {"document_id": "2", "title": "Trade", "url": "https://x.org/a/trade", "text": about("tariffs and trade")}]
    code, out = run("update", lines(tmp_path / "a.jsonl", first))
    assert code == 0 and out["published"] and out["added"] == 2
    code, out = run("ask", "tariffs and trade")
    assert out["grounded"] and out["sources"][0]["url"] == "https://x.org/a/trade" and "[Source 1]" in out["answer"]
    assert run("search", "rivers")[1][0]["title"] == "Rivers"
    assert run("validate")[0] == 0 and run("validate", "--strict")[0] == 1
    code, out = run("update", lines(tmp_path / "b.jsonl", [{"document_id": "2", "title": "Trade", "url": "https://x.org/a/trade", "text": about("customs unions")}]))
    assert (out["added"], out["updated"], out["total"]) == (0, 1, 2)
    assert not run("ask", "tariffs")[1]["grounded"] or "tariffs" not in run("ask", "tariffs")[1]["answer"]
    assert len(run("status")[1]["versions"]) == 2
    run("rollback")
    assert "tariffs" in run("ask", "tariffs and trade")[1]["answer"]
    # of two documents of one address the richer stays
    bad = [{"document_id": "3", "title": "Twin", "url": "https://www.x.org/a/rivers/", "text": about("twins")}]
    code, out = run("update", lines(tmp_path / "c.jsonl", bad))
    assert code == 0 and out["url_duplicates_collapsed"] == 1 and run("validate")[0] == 0
