import contextlib
import io
import json
import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom import api, cli, doctor, embedded, engine, reports
from graphloom.config import Settings, Thresholds, load_settings, parse_settings
from graphloom.errors import AnalysisError, ConfigurationError, RepositoryNotFound
from graphloom.operators import packs
from graphloom.sources import baselines, files, git


def write(root, sources):
    for name, body in sources.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return root


def commit(root, message="change", when="2024-01-01T00:00:00+02:00", author="A <a@x>"):
    env = {"GIT_COMMITTER_DATE": when, "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@x", "PATH": "/usr/bin:/bin", "HOME": str(root)}
    for arguments in (["init", "-q", "-b", "main"], ["add", "-A"], ["commit", "-q", "--allow-empty", "-m", message, f"--author={author}"]):
        subprocess.run(["git", "-C", str(root), *arguments], check=True, env=env, capture_output=True)


TANGLED = "def tangled(a):\n" + "".join(f"    if a == {k}:\n        return {k}\n" for k in range(11)) + "    return a\n"


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    return write(tmp_path_factory.mktemp("project"), embedded.SOURCES)


@pytest.fixture(scope="module")
def analysis(spark, project):
    return api.analyze(spark, project, Settings(), use_history=False)


def test_findings_of_the_project(analysis):
    rows = analysis.findings.collect()
    assert len(rows) == 12 and analysis.file_count == 6 and analysis.cycles == [["shop", "shop.cart", "shop.price"]]
    assert analysis.score.low == 5 and analysis.score.medium == 1 and analysis.score.high == 6
    dead = next(r for r in rows if r.rule_id == "dead-code/unused-private-function")
    assert json.loads(dead.details) == {"name": "_unused", "kind": "function", "callers": 0} and not analysis.warnings


def test_reports(analysis, project, tmp_path):
    document = json.loads(reports.json_text(analysis))
    assert document["score"]["severity_counts"]["high"] == 6 and document["graph"]["cycles"] and document["history"] is None
    levels = [(-f["severity_level"], f["path"], f["line"] or 0) for f in document["findings"]]
    assert levels == sorted(levels) and document["findings"][0]["is_new"] is None and "9f8e7d" not in reports.json_text(analysis)
    sarif = json.loads(reports.sarif_text(analysis))["runs"][0]
    assert len(sarif["results"]) == 12 and len(sarif["tool"]["driver"]["rules"]) == len({r["ruleId"] for r in sarif["results"]})
    assert all(r["locations"][0]["physicalLocation"]["region"]["startLine"] >= 1 for r in sarif["results"])
    assert "1 more are not shown" in reports.markdown_text(analysis, top=4) and "### security" in reports.markdown_text(analysis)
    page = reports.html_text(analysis, top=3)
    assert page.count("data-severity=") == 3 and "9 more are not shown" in page and "&lt;-&gt;" in page
    shown = reports.terminal_text(analysis, analysis.at_or_above(3), 2)
    assert "and 4 more" in shown and "grade" in shown
    assert reports.dot_text(analysis).startswith("digraph") and '"shop" -> "shop.cart";' in reports.dot_text(analysis)
    reports.save_findings(analysis.findings, str(tmp_path / "f"))
    assert analysis.findings.sparkSession.read.parquet(str(tmp_path / "f")).count() == 12


def test_baseline(spark, analysis, project, tmp_path):
    path = tmp_path / "b.json"
    assert baselines.save(analysis.findings, path) == 12
    loaded = baselines.load(path)
    again = api.analyze(spark, project, Settings(), api.Options(baseline=loaded), False)
    assert again.new_findings.count() == 0 and again.baseline_size == loaded.size == 11 and again.score == analysis.score
    assert api.gate_failures(again, None, True) == [] and len(api.gate_failures(analysis, 100, True)) == 2
    extra = write(tmp_path / "more", embedded.SOURCES | {"shop/extra.py": '"""X."""\n\n\ndef wide(a, b, c, d, e, f, g):\n    """W."""\n'})
    more = api.analyze(spark, extra, Settings(), api.Options(baseline=loaded), False)
    assert [r.rule_id for r in more.new_findings.collect()] == ["maintainability/too-many-parameters"]
    assert api.review(more).items[0].path == "shop/extra.py"
    for text in ("[]", "{", '{"version": 2}', '{"version": 1}', '{"version": 1, "findings": [{}]}'):
        path.write_text(text)
        with pytest.raises(ConfigurationError):
            baselines.load(path)
    with pytest.raises(ConfigurationError):
        baselines.resolve(project, tmp_path / "none.json")
    assert baselines.resolve(project) is None and baselines.resolve(project, path, use=False) is None


def test_suppression_and_unknown_rules(spark, project):
    a = api.analyze(spark, project, Settings(ignore=("security/weak-hash", "dead-code/unused-import@shop/cart.py", "no/rule")), use_history=False)
    assert a.suppressed.count() == 3 and a.findings.count() == 9 and len(a.warnings) == 1


def test_history_and_trend(spark, tmp_path):
    root = write(tmp_path / "repo", {"pkg/m.py": TANGLED, "notes.txt": "x"})
    for k in range(5):
        write(root, {"pkg/m.py": TANGLED.replace("return a\n", f"return a + {k}\n") + "\n\ndef calm():\n    return 1\n"})
        commit(root, f"c{k}", f"2024-01-0{k + 1}T00:00:00+02:00", f"P{k % 2} <p@x>")
    a = api.analyze(spark, root, Settings())
    (past,) = a.history.collect()
    assert (past.path, past.commits, past.authors, a.history_info["total_commits"], a.history_info["branch"]) == ("pkg/m.py", 5, 2, 5, "main")
    churn = {r.qualname: (r.commits, r.authors) for r in a.churn.collect()}
    assert churn == {"pkg.m.tangled": (5, 2), "pkg.m.calm": (1, 1)}
    (hot,) = a.findings.where("rule_id = 'history/complexity-hotspot'").collect()
    assert json.loads(hot.details)["scope"] == "function" and hot.severity == 2
    b = api.analyze(spark, root, Settings(blame_files=0))
    assert json.loads(b.findings.where("rule_id = 'history/complexity-hotspot'").first().details)["scope"] == "file" and b.churn is None
    assert json.loads(reports.json_text(a))["history"]["files"][0]["commits"] == 5
    inner = api.analyze(spark, root / "pkg", Settings())
    assert [r.path for r in inner.history.collect()] == ["m.py"] and inner.churn.count() == 2
    write(root, {"pkg/m.py": '"""Calm."""\n'})
    commit(root, "calm", "2024-02-01T00:00:00Z")
    report = api.trend(spark, root, samples=3, window=50)
    assert [s["subject"] for s in report["samples"]] == ["c0", "c3", "calm"] or len(report["samples"]) == 3
    assert report["samples"][-1]["score"] == 100 > report["samples"][0]["score"] and report["delta"] > 0
    assert "worst" in reports.trend_text(report) and reports.trend_text(report, "markdown").count("\n| ") >= 3
    assert len(api.trend(spark, root, samples=20)["samples"]) == 6


def test_changed_paths(spark, tmp_path):
    root = write(tmp_path / "repo", {"a.py": "x = 1\n", "b.py": "y = 1\n", "c.py": "z = 1\n"})
    commit(root, "one")
    write(root, {"a.py": "x = 2\n"})
    commit(root, "two")
    write(root, {"b.py": "y = 2\n", "new.py": "", "no.txt": ""})
    assert git.changed_paths(root, "HEAD~1") == {"a.py", "b.py", "new.py"} and git.changed_paths(root, "HEAD") == {"b.py", "new.py"}
    with pytest.raises(AnalysisError):
        git.changed_paths(root, "nonsense")
    with pytest.raises(AnalysisError):
        git.changed_paths(tmp_path, "HEAD")
    a = api.analyze(spark, root, Settings(), engine.changed_since(root, "HEAD"), False)
    assert a.file_count == 2 and a.scope_label == "HEAD"
    assert git.head(tmp_path) is None


def test_discovery(tmp_path):
    root = write(tmp_path, {"pkg/a.py": "", "pkg/_b.py": "", ".venv/x.py": "", "pkg/__pycache__/y.py": "", "pkg/.hidden/z.py": "", "build/q.py": "", "pkg/t.txt": "", "a-b/x.py": "", "a/x.py": ""})
    assert files.python_files(root) == ["a/x.py", "a-b/x.py", "pkg/_b.py", "pkg/a.py"]
    assert files.python_files(root, ["pkg/_*", "a-b"]) == ["a/x.py", "pkg/a.py"]
    (root / "link.py").symlink_to(root / "pkg/a.py")
    assert "link.py" not in files.python_files(root)
    commit(root)
    (root / ".gitignore").write_text("a/\n")
    write(root, {"pkg/new.py": ""})
    assert files.python_files(root)[0] == "a/x.py" and "pkg/new.py" in files.python_files(root)


def test_settings(tmp_path):
    assert load_settings(tmp_path) == Settings()
    (tmp_path / "pyproject.toml").write_text('[tool.graphloom]\nexclude = ["a"]\n[tool.graphloom.thresholds]\ncyclomatic_warn = 3\n')
    assert load_settings(tmp_path).thresholds == Thresholds(cyclomatic_warn=3)
    (tmp_path / "graphloom.toml").write_text("history_commits = 7\n")
    assert load_settings(tmp_path).history_commits == 7
    (tmp_path / "own.toml").write_text("[graphloom]\nblame_files = 0\n")
    assert load_settings(tmp_path, tmp_path / "own.toml").blame_files == 0
    with pytest.raises(ConfigurationError):
        load_settings(tmp_path, tmp_path / "none.toml")
    for table in (
        {"nope": 1}, {"thresholds": {"nope": 1}}, {"thresholds": {"cyclomatic_warn": True}}, {"thresholds": 3}, {"exclude": "a"}, {"exclude": [1]}, {"ignore": ["@x"]}, {"ignore": ["r@"]},
        {"use_git_history": 1}, {"history_commits": 0}, {"history_commits": True}, {"blame_files": -1}, {"llm": {"api_key": "x"}}, {"llm": {"timeout": 0}}, {"semantic": {"provider": "x"}},
        {"semantic": {"min_score": 2}}, {"semantic": {"model": " "}}, {"semantic": {"top_k": 0}},
    ):
        with pytest.raises(ConfigurationError):
            parse_settings(table)


class Model:
    def __init__(self, answer):
        self.answer = answer

    def complete(self, *, system, user):
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer


def test_explanations_and_reviews(analysis):
    reference = "security/weak-hash@shop/run.py:16"
    plain = api.explain(analysis, reference)
    assert plain.summary == plain.facts.message and plain.notes and "measured" in plain.why[1]
    said = api.explain(analysis, "security/weak-hash", Model('```json\n{"summary": " S ", "why": ["w", 1, ""], "actions": "x"}\n```'), "m")
    assert (said.summary, said.why, said.actions, said.model) == ("S", ("w",), (), "m")
    for answer in ("no json", "[1]", '{"summary": ""}', RuntimeError("down")):
        assert api.explain(analysis, reference, Model(answer)).notes
    with pytest.raises(AnalysisError):
        api.explain(analysis, "security/weak-hash@other.py")
    with pytest.raises(AnalysisError):
        packs.parse_reference("@x")
    assert packs.parse_reference("r@a:b:7") == ("r", "a:b", 7) and packs.parse_reference("r@a:b") == ("r", "a:b", None)
    items = [{"path": "shop/run.py", "line": True, "severity": "HIGH"}, {"path": "made/up.py"}, "x", {"line": 3}]
    seen = api.review(analysis, 20, Model(json.dumps({"summary": "R", "items": items})))
    assert [(i.path, i.line, i.severity) for i in seen.items] == [("shop/run.py", None, "high")] and "made/up.py" in seen.notes[0]
    assert len(api.review(analysis, 3).items) == 3 and "1. high" in reports.review_text(api.review(analysis, 3))
    assert json.loads(reports.explanation_text(plain, "json"))["finding"]["line"] == 16 and "###" in reports.explanation_text(plain, "markdown")


def run(*arguments):
    out, err = io.StringIO(), io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
        code = cli.main([str(a) for a in arguments])
    return code, out.getvalue(), err.getvalue()


def test_command_line(spark, project, tmp_path):
    code, out, _ = run("analyze", project, "--format", "json", "--no-history", "--severity", "high", "--fail-under", "100")
    assert code == 1 and {f["severity"] for f in json.loads(out)["findings"]} == {"high"}
    assert run("baseline", project, "-o", tmp_path / "b.json")[0] == 0
    assert run("analyze", project, "--no-history", "--baseline", tmp_path / "b.json", "--fail-on-new")[0] == 0
    assert run("analyze", project, "-f", "html", "-o", tmp_path / "r" / "x.html", "--no-history")[0] == 0 and (tmp_path / "r/x.html").read_text().startswith("<!doctype")
    assert run("analyze", tmp_path / "none")[0] == 2 and run("analyze", project, "--baseline", tmp_path / "no.json")[0] == 2
    assert "helper" in run("search", "helper amount", project)[1] and json.loads(run("search", "helper", project, "-f", "json", "--top", 2)[1])["results"]
    (project / "graphloom.toml").write_text(f'[semantic]\nindex_dir = "{tmp_path}/index"\n')
    assert run("search", "helper", project, "--mode", "semantic")[0] == 2
    assert json.loads(run("index", project)[1])["embedded"] > 5 and json.loads(run("index", project)[1])["embedded"] == 0
    assert "shop.price.helper" in run("search", "help while helper", project, "--mode", "semantic", "--min-score", "0.05")[1]
    assert "weak" in run("explain", "security/weak-hash", project)[1].lower() and run("explain", "no/rule", project)[0] == 2
    assert "need attention" in run("review", project, "--top", 2)[1] and run("trend", project)[0] == 2
    assert "design/god-object" in run("rules")[1]
    checks = {c.name: c.status for c in doctor.run_checks(project)}
    assert checks["pyspark"] == checks["java"] == checks["configuration"] == "ok" and run("doctor", project)[0] == 0
    (project / "graphloom.toml").unlink()
    with pytest.raises(RepositoryNotFound):
        api.analyze(spark, Path(tmp_path / "none"))


def test_a_broken_rule_is_a_warning(spark, project, monkeypatch):
    from graphloom.operators import rules

    bad = rules.Rule("x/y", "t", "d", "s", lambda c: rules._match(c.modules, F.col("no_such_column"), level=F.lit(1), message=F.lit("m")))
    found, warnings = rules.run(rules.Context(api.analyze(spark, project, Settings(), use_history=False).modules), (bad, rules.RULES[0]))
    assert found.count() == 1 and len(warnings) == 1 and "x/y" in warnings[0]


def test_progress(spark, project):
    seen = []
    api.analyze(spark, project, Settings(), use_history=False, listen=lambda p: seen.append(p.stage))
    assert seen == ["discovering", "parsing", "graph", "rules"]
