"""A tree on disk from end to end, and what stands around it: settings, models, errors, ledgers, locks, git."""

import os
import subprocess

import pytest

from heartwood import config as settings
from heartwood.functions import errors
from heartwood.operators import ignore, models, refresh
from heartwood.operators.health import coverage
from heartwood.sources import git, store


@pytest.fixture()
def root(tmp_path):
    for path, text in {"a.py": "def f(): ...\n", "src/b.go": "func Open() {}\n", "src/deep/c.txt": "x" * 50, "src/deep/d.bin": "\0\1", "tmp/no.txt": "-", "x.tmp": "-", "own/skip.me": "-", ".ctxignore": "*.me\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    os.symlink(tmp_path / "src", tmp_path / "src" / "deep" / "loop")
    return tmp_path


def conf(**more):
    return settings.Config(provider="ollama", model="m: # odd", resume_cooldown_seconds=0, **more)


def test_refresh_from_end_to_end(spark, root):
    home = root.parent / "home"
    seen = []
    stats = refresh.refresh(spark, str(root), conf(), models.Deterministic(), progress=lambda *x: seen.append(x), home=str(home))
    assert (stats.strategy, stats.dirs_processed, stats.files_processed, stats.files_binary, stats.errors) == ("full", 4, 5, 1, [])
    assert [x[0] for x in seen] == [2, 1, 0] and seen[-1][1:3] == (4, 4)
    text = (root / "src" / "CONTEXT.md").read_text()
    assert "- **b.go** — Summary for b.go" in text and "- **deep/** — Holds 2 files and 0 directories." in text and "dirs: 1" in text
    assert [(r.path, r.status) for r in refresh.status(spark, str(root)).collect()] == [(p, "fresh") for p in (".", "own", "src", "src/deep")]
    assert refresh.check(spark, str(root), "verify")[0].count() == 0
    again = refresh.refresh(spark, str(root), conf(), models.Deterministic(), home=str(home))
    assert (again.strategy, again.dirs_processed, again.dirs_skipped) == ("incremental", 0, 4)
    (root / "src" / "deep" / "c.txt").write_text("new")
    one = refresh.run(spark, str(root), conf(), models.Deterministic(), True, ["src/deep/c.txt"])
    assert one.dirs_processed == 3
    assert coverage(refresh.status(spark, str(root))).first().stale == 0
    runs = store.read_runs(spark, store.ledger_folder(str(root), None))
    assert runs.count() == 2 and store.global_board(spark, store.global_folder(str(home)))[1].first().total_runs == 2
    out = refresh.export_context(spark, str(root), depth=1)
    assert out.startswith("# CONTEXT.md\n\n---") and "# src/CONTEXT.md" in out and "deep/CONTEXT.md" not in out
    with pytest.raises(errors.ConfirmationRequired):
        refresh.reset(spark, str(root))
    assert len(refresh.reset(spark, str(root), dry_run=True)) == 4 == len(refresh.reset(spark, str(root), yes=True))
    assert not refresh.has_manifests(spark, str(root)) and refresh.check(spark, str(root))[1].first().missing == 4


class Failing(models.Deterministic):
    def directory(self, directory, files, subdirs):
        if directory == "src":
            raise ValueError("rate limit")
        return super().directory(directory, files, subdirs)


def test_failures_and_budgets(spark, root):
    stats = refresh.run(spark, str(root), conf(), Failing(), False)
    assert stats.dirs_processed == 3 and stats.errors == ["src: rate limit"]
    for path in refresh.reset(spark, str(root), yes=True):
        assert not (root / path).exists()
    stats = refresh.run(spark, str(root), conf(token_budget=1), models.Deterministic(), False)
    assert stats.budget_exhausted and stats.dirs_processed == 1 and stats.dirs_skipped == 3
    done = refresh.refresh(spark, str(root), conf(token_budget=1), models.Deterministic(), until_complete=True, changed=[], home=str(root.parent))
    assert done.strategy == "incremental" and refresh.check(spark, str(root))[1].first().missing == 0


def test_watch(spark, root, tmp_path_factory):
    refresh.run(spark, str(root), conf(), models.Deterministic(), False)
    (root / "a.py").write_text("def g(): ...\n")
    spark.createDataFrame([("a.py",)], "path string").write.parquet(folder := str(tmp_path_factory.mktemp("events") / "e"))
    told = []
    query = refresh.watch(spark, spark.readStream.schema("path string").parquet(folder), str(root), conf(), models.Deterministic(), told.append)
    query.processAllAvailable()
    query.stop()
    assert told[0]["dirs_processed"] == 1 and told[0]["stale"] == 0


def test_git_changes(spark, tmp_path):
    run = lambda *c: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e", *c], cwd=tmp_path, check=True, capture_output=True)
    with pytest.raises(git.GitError):
        git.changed_paths(str(tmp_path))
    run("init", "-q")
    (tmp_path / "a b.txt").write_text("1")
    assert git.changed_paths(str(tmp_path)) == ["a b.txt"]  # before the first commit
    run("add", ".")
    run("commit", "-qm", "x")
    (tmp_path / "a b.txt").write_text("2")
    (tmp_path / "CONTEXT.md").write_text("new")
    assert [r.path for r in git.changed_files(spark, str(tmp_path)).collect()] == ["a b.txt"]
    assert [tuple(r) for r in refresh.check(spark, str(tmp_path), "diff")[0].collect()] == [("CONTEXT.md", "new")]


def test_settings(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".ctxconfig").write_text("provider: ollama\nmax_depth: 3\nbatch_size: 4\nprompts: {file_user: hi, odd: x}\nextensions: .py\n")
    c = settings.load(str(tmp_path / "sub"), {"CTX_MAX_DEPTH": "none", "CTX_MODEL": " m ", "CTX_CACHE_PATH": ""}, token_budget=7)
    assert (c.provider, c.max_depth, c.files_per_call, c.model, c.token_budget, c.cache_path, c.extensions) == ("ollama", None, 4, "m", 7, "", [".py"])
    assert models.prompts(c.prompts)["file_user"] == "hi" and "odd" not in models.prompts(c.prompts) and store.ledger_folder("r", "") is None
    assert settings.load(str(tmp_path / "sub"), {}, provider="openai", needs_key=False).model == "gpt-4o-mini"
    (tmp_path / ".ctxconfig").write_text("- 1\n")
    with pytest.raises(settings.ConfigError):
        settings.load(str(tmp_path), {})
    (tmp_path / ".ctxconfig").unlink()
    with pytest.raises(settings.MissingKey):
        settings.load(str(tmp_path), {"CTX_PROVIDER": "openai"})


class Refusing(models.Deterministic):
    def files(self, directory, entries):
        return super().files(directory, entries)[: 1 if len(entries) > 1 else None]

    def directory(self, directory, files, subdirs):
        if any(len(f["summary"]) > models.SHORT for f in files):
            raise models.BadRequest("too long")
        return super().directory(directory, files, subdirs)


def test_models():
    t = models.Tolerant(Refusing())
    assert [a.text for a in t.files("d", [{"name": "a"}, {"name": "b"}])] == ["Summary for a", "Summary for b"] and t.single and t.fallbacks == 1
    assert "1 files" in t.directory("d", [{"name": "a", "summary": "x" * 500}], []).text
    waits = []

    def flaky():
        raise TimeoutError("slow")

    with pytest.raises(RuntimeError, match="transient"):
        models.with_retries(flaky, sleep=waits.append)
    assert waits == [1, 2, 4, 8]
    assert '"index": 1' in models.files_request("d", [{"name": "é", "content": "c"}]) and "\\u00e9" in models.files_request("d", [{"name": "é", "content": "c"}])
    assert models.chosen_model(conf(), models.Deterministic()) == "deterministic" and models.create(conf(), "deterministic").model == "deterministic"


def test_errors_json_and_locks(tmp_path):
    assert errors.classify(TimeoutError("t"))[0] == "provider_unreachable" and errors.classify(settings.MissingKey("k"))[0] == "provider_not_configured" and errors.classify(KeyError("x"))[0] == "unknown_error"
    assert [errors.envelope("c", d, e)["status"] for d, e in (({}, []), ({}, [ValueError()]), ({"a": 1}, [ValueError()]))] == ["success", "error", "partial"]
    path = str(tmp_path / "n" / "x.json")
    store.save_json(path, {"a": "é"})
    assert store.load_json(path, {}) == {"a": "é"} and store.load_json(path + "x", {"d": 1}) == {"d": 1} and os.listdir(tmp_path / "n") == ["x.json"]
    (tmp_path / "n" / "x.json").write_text("[1]")
    assert store.load_json(path, {}) == {}
    with store.Lock(str(tmp_path), "one"):
        with pytest.raises(store.LockHeld):
            store.Lock(str(tmp_path), "two").__enter__()
    (tmp_path / ".ctx-cache" / "lock").write_text("pid=999999999\ntimestamp=1\ncommand=old\n")
    with store.Lock(str(tmp_path), "three") as lock:
        assert lock.holder()["command"] == "three"
    assert not (tmp_path / ".ctx-cache" / "lock").exists()


def test_json_columns(spark):
    rows = spark.createDataFrame([('{"a": "x", "b": 1}',), ("[1]",), ("{bad",), (None,)], "t string")
    assert [r[0] for r in rows.select(store.texts_only(rows.t)).collect()] == [{"a": "x"}, {}, {}, {}]


def test_ignore_defaults(tmp_path):
    (tmp_path / ".ctxignore").write_text("# c\n!keep.tmp\n")
    assert ignore.rule_lines(ignore.load(str(tmp_path)))[-1] == "!keep.tmp" and "*.tmp" in ignore.load(str(tmp_path))
