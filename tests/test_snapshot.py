"""Export and validation end to end on the two small snapshots, and every tampering with a published one."""

import hashlib
import json
import shutil
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.operators.dedup import ConflictError
from tessella.plans import export, media, normalize, state, validate
from tessella.sources import text as scans
from tessella.sources.capture import capture_fingerprint


def snapshot(root: Path, gaps: bool = False) -> tuple[str, str]:
    selected, files = root / "selected", root / "media"
    (selected / "posts").mkdir(parents=True)
    (selected / "normalized").mkdir()
    slides = [{"tiktokLink": f"https://x/{i}", "downloadLink": f"https://y/{i}"} for i in range(10)]
    show = {"id": "7100000000000000001", "input": "Creator", "isSlideshow": True, "slideshowImageLinks": slides, "authorMeta": {"name": "creator", "avatar": "https://a/b"}, "playCount": 0, "text": "Tiếng Việt 日本語\ncaption", "extra_field": {"untouched": [None, False, 123]}}
    video = {"id": "7100000000000000002", "input": "Creator", "isSlideshow": None, "slideshowImageLinks": [], "authorMeta": {"name": "creator"}, "playCount": 42, "hashtags": ["a", {"name": "b"}, {"title": "c"}, "", {}, 5]}
    lines = [json.dumps(show, ensure_ascii=False), "", json.dumps(video), json.dumps(dict(reversed(video.items())))]
    (selected / "posts" / "Creator.jsonl").write_text("﻿" + "\n".join(lines), encoding="utf-8")
    (selected / "normalized" / "posts.jsonl").write_text(json.dumps({"account": "Creator", "post_id": show["id"], "caption": "over", "extra": {"k": [1]}}) + "\n")
    info = {"actor": "x", "finished_at": "2024", "accounts": ["Creator"], "batches": [{"batch_index": 1, "status": "SUCCEEDED"}], "manifest": {"error_records": 0}}
    (selected / "run_info.json").write_text(json.dumps(info))
    a = files / "creator" / show["id"]
    b = files / "creator" / video["id"]
    for d in (a, b, files / "creator" / "profile"):
        d.mkdir(parents=True)
    for d in (a, b):
        (d / "cover.jpg").write_bytes(b"cover")
    for i in range(1, 11):
        if not gaps or i > 2:
            (a / f"slide_{i:03d}.jpg").write_bytes(b"slide" + (b"same" if i < 3 else str(i).encode()))
    if gaps:
        (a / "slide_002.jpg").write_bytes(b"")
    else:
        (b / "video.mp4").write_bytes(b"video")
    (files / "creator" / "profile" / "avatar.jpeg").write_bytes(b"avatar")
    return str(selected), str(files)


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("full")
    told = export.export_dataset(spark, *snapshot(root), str(root / "out"), archive=True)
    return root, told


def test_full_snapshot(spark, published):
    root, told = published
    n = told["counts"]
    assert n["posts"] == 2 and n["accounts"] == 1 and n["content_types"] == {"slideshow": 1, "video": 1} and n["duplicate_post_rows_removed"] == 1
    assert n["source_media_files"] == 14 and n["unique_assets"] == 12 and n["source_media_by_role"] == {"avatar": 1, "cover": 2, "slide": 10, "video": 1}
    assert n["missing_assets"] == 0 and told["completion"] == {"capture": True, "media": True, "complete": True}
    posts = [json.loads(x) for x in (root / "out" / "posts.jsonl").read_text(encoding="utf-8").splitlines()]
    assert [p["post_id"][-1] for p in posts] == ["1", "2"]
    assert posts[0]["raw"]["extra_field"] == {"untouched": [None, False, 123]} and posts[0]["metadata"]["extra"] == {"k": [1]} and posts[1]["content_type"] == "video"
    assert [s["index"] for s in posts[0]["media"]["slides"]] == list(range(1, 11)) and posts[0]["source"]["record"] == 1 and posts[1]["source"]["record"] == 2
    assert (root / "out" / "posts.csv").read_bytes().startswith(b"\xef\xbb\xbfpost_uid,account_id")
    assert export.verify_zip(root / "out.zip", root / "out")
    with zipfile.ZipFile(root / "out.zip") as z:
        assert all(i.compress_type == (zipfile.ZIP_STORED if "/assets/" in i.filename else zipfile.ZIP_DEFLATED) for i in z.infolist())
    report = validate.validate(spark, str(root / "out"))
    assert report == {"ok": True, "posts": 2, "assets": 12, "missing_assets": 0, "issues": []}
    with pytest.raises(export.ExportError):
        export.export_dataset(spark, str(root / "selected"), str(root / "media"), str(root / "out"))


def test_gaps(spark, tmp_path):
    selected, files = snapshot(tmp_path, gaps=True)
    posts, _ = export.load_posts(scans.posts(spark, selected))
    parts = export.snapshot(posts.persist(), scans.media_files(spark, files))
    assert {(r.kind, r["index"], r.reason) for r in parts["missing"].collect()} == {("slide", 1, "not_found"), ("slide", 2, "empty_file"), ("video", None, "not_found")}
    assert [(r.media_status, r.expected_slide_count, r.available_slide_count) for r in parts["posts"].orderBy("post_id").collect()] == [("incomplete", 10, 8), ("incomplete", 0, 0)]
    assert parts["files"].where("length = 0").count() == 1


def test_refusals(spark, tmp_path):
    selected, files = snapshot(tmp_path)
    p = Path(selected, "posts", "Creator.jsonl")
    good = p.read_text(encoding="utf-8")
    changed = json.loads(good.split("\n")[2]) | {"playCount": 43}
    for bad, error in (("\n" + json.dumps(changed), ConflictError), ("\n[]", scans.InputError), ('\n{"input": "x"}', export.ExportError), ('\n{"id": "../x", "input": "x"}', export.ExportError), ('\n{"id": "1", "input": "unknown"}', export.ExportError)):
        p.write_text(good + bad, encoding="utf-8")
        with pytest.raises(error):
            export.load_posts(scans.posts(spark, selected))
    p.write_text(good, encoding="utf-8")
    extra = Path(files, "creator", "7100000000000000001", "slide_001.png")
    extra.write_bytes(b"two at one place")
    with pytest.raises(export.ExportError):
        export.export_dataset(spark, selected, files, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def edit(path: Path, change) -> None:
    rows = [json.loads(x) for x in path.read_text(encoding="utf-8").splitlines()]
    change(rows)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")


#: Tamperings that can be made together, and the rules that must each report them.
MUTATIONS = [
    ({"V11", "V12", "V16", "V9", "V7"}, [
        lambda d: edit(d / "posts.jsonl", lambda r: (r[1]["media"]["videos"].append("sha256:0"), r[0].update(raw=[]), r.append(r[1]))),
        lambda d: (d / "extra.txt").write_text("x"),
        lambda d: edit(d / "assets.jsonl", lambda r: r[0].update(bytes=1)),
    ]),
    ({"V10", "V15", "V19", "V6"}, [
        lambda d: edit(d / "posts.jsonl", lambda r: (r[0].update(media_status="incomplete"), r[0]["media"]["slides"].reverse(), r[1].update(post_id=7))),
        lambda d: edit(d / "assets.jsonl", lambda r: r[0].update(asset_id="sha256:1")),
    ]),
    ({"V14", "V20", "V13", "V24", "V5", "V8", "V18"}, [
        lambda d: edit(d / "posts.jsonl", lambda r: (r[0]["media"]["slides"][0].update(index=True), r[0].update(available_slide_count=3), r[1]["media"].update(covers={}))),
        lambda d: edit(d / "assets.jsonl", lambda r: r[0].update(path="assets/../x")),
        lambda d: (d / "missing_assets.jsonl").write_text('{"post_uid": "POST-0"}\n'),
    ]),
    ({"V2", "V3", "V17", "V21"}, [
        lambda d: (d / "posts.jsonl").write_text(""),
        lambda d: (d / "checksums.sha256").write_text((d / "checksums.sha256").read_text() + "no digest\n"),
    ]),
]


def test_mutations(spark, published, tmp_path):
    root, _ = published
    for n, (rules, changes) in enumerate(MUTATIONS):
        d = tmp_path / str(n)
        shutil.copytree(root / "out", d)
        for change in changes:
            change(d)
        if "V2" not in rules:  # checksums that agree again don't hide anything
            lines = [x.split("  ", 1)[1] for x in (d / "checksums.sha256").read_text().splitlines()]
            (d / "checksums.sha256").write_text("".join(f"{hashlib.sha256((d / x).read_bytes()).hexdigest()}  {x}\n" for x in lines))
        found = {r.rule for r in validate.violations(spark, str(d)).collect()}
        assert rules <= found, (rules, found)


def test_manifest_rules(published):
    root, told = published
    good = json.loads((root / "out" / "manifest.json").read_text())
    rules = lambda change, n=(2, 12, 0): [r for r, _, _ in validate.manifest_violations(json.loads(json.dumps(good | change)), *n)]
    done, capture = good["completion"], good["capture"]
    assert rules({}) == []
    assert rules({"schema_version": "x"}) == ["V1"]
    assert rules({}, (3, 12, 0)) == ["V21"] and rules({"counts": []}) == ["V21"]
    assert rules({"capture": None}) == ["V22"]
    assert rules({"completion": done | {"capture": False}}) == ["V22"]
    assert rules({"completion": done | {"capture": 1}, "capture": capture | {"complete": 1}}) == ["V22"]
    assert rules({"completion": done | {"media": False}}) == ["V23"]
    assert rules({"completion": None}) == []


def test_normalizer_and_plan(spark, tmp_path):
    selected, _ = snapshot(tmp_path)
    rows = scans.posts(spark, selected)
    n = {r.post_id: r for r in normalize.normalized_posts(rows, ["source_file", "record"]).collect()}
    assert n["7100000000000000002"].hashtags == ["a", "b", "c", "5"] and n["7100000000000000001"].views == 0 and n["7100000000000000002"].views == 42
    assert n["7100000000000000002"].likes is None and n["7100000000000000002"].caption == ""
    jobs = media.download_jobs(rows)
    assert {r.kind: r["count"] for r in jobs.groupBy("kind").count().collect()} == {"slide": 10, "avatar": 1}
    first = jobs.where("kind = 'slide' and index = 1").first()
    assert [c.source for c in first.candidates] == ["tiktok_slide", "apify_slide"] and first.path.endswith("slide_001.jpg")
    meta = normalize.compact_metadata(rows).select("meta.*").where("slide_count = 10").first()
    assert meta.is_slideshow and meta.hashtags == [] and meta.author["name"] == "creator"
    good, bad = normalize.split_items(rows.withColumn("raw", F.when(F.col("record") == 1, F.try_parse_json(F.lit('{"error": "x"}'))).otherwise(F.col("raw"))))
    assert bad.count() == 1 and good.count() == 2


def test_scans(spark, tmp_path):
    p = tmp_path / "accounts.txt"
    p.write_text("﻿# list\n@creator\n\nhttps://www.tiktok.com/@Creator?x=1\n other \n", encoding="utf-8")
    assert [r.account for r in scans.accounts(spark, str(p)).orderBy("ord").collect()] == ["creator", "other"]
    p = tmp_path / "x.jsonl"
    p.write_text('﻿{"a": 1}\n\n[]\n{"a": 2}\n{"a"\n', encoding="utf-8")
    rows, bad = scans.jsonl_tolerant(spark, str(p))
    assert rows.count() == 2 and sorted(r.line for r in bad.collect()) == [3, 5]
    with pytest.raises(scans.InputError, match=":3: not a JSON object"):
        scans.jsonl(spark, str(p))


def test_values_are_published_verbatim(spark):
    item = {"id": "1", "input": "A", "playCount": "12", "diggCount": 1.5, "commentCount": 10**20, "shareCount": True, "isPinned": "yes", "hashtags": ["null", None, True, 5, {"name": 7}, "x"], "videoMeta": {"width": 1.5}}
    df = spark.createDataFrame([(json.dumps(item),)], "raw_json string").withColumn("raw", F.try_parse_json("raw_json"))
    n = normalize.normalize(df)
    told = json.loads(n.select(normalize.published(n).alias("p")).first().p)
    assert [told[k] for k in ("views", "likes", "comments", "shares", "is_pinned", "video_width")] == ["12", 1.5, 10**20, True, "yes", 1.5]
    assert told["hashtags"] == ["null", "None", "True", "5", "7", "x"] and list(told) == list(normalize.COLUMNS)
    r = n.first()
    assert (r.views, r.likes, r.shares, r.is_pinned, r.video_width) == (None, None, None, None, None)  # nothing is rounded into a type


def report_of(selected, files):
    rows = {p.relative_to(files).as_posix(): {"sha256": hashlib.sha256(p.read_bytes()).hexdigest(), "bytes": p.stat().st_size} for p in Path(files).rglob("*") if p.is_file()}
    return {"source_fingerprint": capture_fingerprint(Path(selected)), "assets": rows}


def test_verified_media(spark, tmp_path):
    selected, files = snapshot(tmp_path)
    report, place = report_of(selected, files), Path(files, "download_report.json")
    place.write_text(json.dumps(report))
    stray = Path(files, "creator", "7100000000000000002", "stray.mp4")
    stray.write_bytes(b"not listed")
    told = export.export_dataset(spark, selected, files, str(tmp_path / "out"), dry_run=True, require_verified=True)
    assert told["counts"]["source_media_files"] == 14  # the stray file isn't vouched for
    cover = Path(files, "creator", "7100000000000000002", "cover.jpg")
    cover.write_bytes(b"other")
    with pytest.raises(export.ExportError, match="verified media changed"):
        export.export_dataset(spark, selected, files, str(tmp_path / "out"), require_verified=True)
    place.write_text(json.dumps(report | {"source_fingerprint": "0"}))
    with pytest.raises(scans.InputError, match="another capture"):
        export.export_dataset(spark, selected, files, str(tmp_path / "out"), require_verified=True)
    place.write_text(json.dumps(report | {"assets": report["assets"] | {"creator/gone.jpg": {"sha256": "", "bytes": 1}}}))
    with pytest.raises(scans.InputError, match="missing or unsafe"):
        export.export_dataset(spark, selected, files, str(tmp_path / "out"), require_verified=True)


def test_ambiguous_folder_links_and_zip(spark, tmp_path, published):
    files = spark.createDataFrame([("cREATOR/1/cover.jpg", "cREATOR", "1", "cover.jpg"), ("CREATOR/1/cover.jpg", "CREATOR", "1", "cover.jpg")], "relative string, account_dir string, post_dir string, name string")
    files = files.withColumns({"path": F.col("relative"), "length": F.lit(5).cast("long"), "content": F.lit("cover").cast("binary")})
    (tmp_path / "posts").mkdir()
    (tmp_path / "posts" / "Creator.jsonl").write_text('{"id": "1", "input": "Creator"}\n')
    posts, _ = export.load_posts(scans.posts(spark, str(tmp_path)))
    with pytest.raises(export.ExportError, match="ambiguous"):
        export.snapshot(posts, files)
    (tmp_path / "link").symlink_to(tmp_path / "posts")
    with pytest.raises(export.ExportError, match="link"):
        export.witnessed(tmp_path)
    copy = tmp_path / "again"
    shutil.copytree(published[0] / "out", copy)
    made = export.ensure_zip(copy)
    assert made == tmp_path / "again.zip" and export.ensure_zip(copy) == made
    (copy / "README.md").write_text("changed")
    with pytest.raises(export.ExportError, match="differs"):
        export.ensure_zip(copy)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([('{"input": "A", "authorMeta": {"name": "a"}}', 1), ('{"input": "B", "authorMeta": null}', 2), ('{"input": "A", "authorMeta": {"name": "b"}}', 3)], "raw_json string, record long").withColumn("raw", F.try_parse_json("raw_json"))
    export.write_by_account(rows, str(tmp_path / "posts"))
    export.write_by_account(rows.where("record > 1"), str(tmp_path / "posts"))
    assert {(r.account, r.value) for r in spark.read.text(str(tmp_path / "posts")).collect()} == {("A", rows.where("record = 3").first().raw_json), ("B", rows.where("record = 2").first().raw_json)}
    export.write_profiles(normalize.profiles(rows, ["record"]), str(tmp_path / "profiles"))
    (p,) = spark.read.text(str(tmp_path / "profiles")).collect()
    assert p.account == "A" and json.loads(p.value)["authorMeta"] == {"name": "b"}
    export.append_lines(tmp_path / "log" / "x.jsonl", [{"a": 1}])
    export.append_lines(tmp_path / "log" / "x.jsonl", [{"a": "é"}, {"a": 3}])
    with (tmp_path / "log" / "x.jsonl").open("a") as f:
        f.write('{"a": ')
    good, bad = scans.jsonl_tolerant(spark, str(tmp_path / "log" / "x.jsonl"))
    assert good.count() == 3 and [r.line for r in bad.collect()] == [4]


def test_small_objects(tmp_path):
    p = tmp_path / "x.json"
    with pytest.raises(FileNotFoundError):
        scans.read_object(p)
    assert scans.read_object(p, missing=True) == {}
    p.write_text("\ufeff{\"a\": 1}", encoding="utf-8")
    assert scans.read_object(p) == {"a": 1}
    p.write_text("[1]")
    with pytest.raises(scans.InputError):
        scans.read_object(p, missing=True)
    assert scans.read_object(p, invalid=True) == {}


def test_media_tree_and_plan_conflicts(spark, tmp_path):
    d = tmp_path / "tree" / "acc" / "7"
    d.mkdir(parents=True)
    (d / "raw.json").write_text('{"id": "70", "x": {"u": "https://www.tiktok.com/@a/video/70"}, "video": "http://h/v"}')
    t = scans.media_tree(spark, str(tmp_path / "tree"))
    (r,) = media.video_plan(t, t.where("false")).collect()
    assert (r.account, r.post_id, r.url, r.direct_urls) == ("acc", "70", "https://www.tiktok.com/@a/video/70", ["http://h/v"])
    make = lambda *items: spark.createDataFrame([(json.dumps(x), n) for n, x in enumerate(items)], "raw_json string, record long").withColumns({"raw": F.try_parse_json("raw_json"), "stem": F.lit("s"), "source_file": F.lit("f")})
    assert media.plan_posts(make({"id": 1, "input": "A"}, {"input": "A", "id": 1}, {"id": 2, "input": "a"})).count() == 2
    with pytest.raises(ConflictError):
        media.plan_posts(make({"id": 1, "input": "A"}, {"id": 1, "input": "a", "n": 2}))
    done = spark.createDataFrame([("image", "downloaded", "a/1", "d", 3), ("video", "existing", "a/2", "e", 4), ("image", "failed", None, None, None)], "kind string, status string, path string, sha256 string, bytes long")
    report = media.download_report(done, "f", "f")
    assert report["failed"] == 1 and set(report["assets"]) == {"a/1", "a/2"}
    with pytest.raises(ConflictError):
        media.download_report(done, "f", "g")


def test_a_hot_account_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(20_000).select(F.to_json(F.struct(F.when(F.col("id") % 10 > 0, F.lit("Hot")).otherwise(F.concat(F.lit("a"), (F.col("id") % 7).cast("string"))).alias("input"), F.col("id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))).alias("raw_json"))
    rows = rows.withColumn("raw", F.try_parse_json("raw_json")).repartition(6)
    advised = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2"}
    for k, v in advised.items():
        spark.conf.set(k, v)
    try:
        export.write_by_account(rows, str(tmp_path / "posts"))
    finally:
        for k in advised:
            spark.conf.unset(k)
    hot = [p.stat().st_size for p in (tmp_path / "posts" / "account=Hot").glob("part-*")]
    assert len(hot) >= 4 and max(hot) < sum(hot) / 2
    assert spark.read.text(str(tmp_path / "posts")).count() == 20_000
    export.write_by_account(rows.where("raw_json like '%\"a1\"%'"), str(tmp_path / "posts"))
    assert {p.name for p in (tmp_path / "posts").glob("account=*")} == {"account=a1"}


def test_rules_read_every_payload_once(published, spark):
    """What the rules join are narrow facts that one projection of the payloads has left: no payload is read or parsed again."""
    plan = validate.violations(spark, str(published[0] / "out"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "variant" not in plan.lower() and "raw" not in plan


def test_run_resumes_after_it_published(spark, tmp_path, monkeypatch):
    selected, files = snapshot(tmp_path)
    place, sets = tmp_path / "runs" / "run.json", tmp_path / "datasets"
    place.parent.mkdir()
    run = lambda: state.run_pipeline(spark, place, selected, files, str(sets), {"a": 1})
    save = state.save
    calls = []

    def fails_once(path, s):
        if s["stages"]["export"]["status"] in ("completed", "partial") and not calls:
            calls.append(1)
            raise KeyboardInterrupt
        save(path, s)

    monkeypatch.setattr(state, "save", fails_once)
    with pytest.raises(KeyboardInterrupt):
        run()
    assert [p.name for p in sets.glob("[0-9]*")] == ["0001"]
    done = run()
    assert done["stages"]["export"]["result"]["dataset"].endswith("0001") and done["stages"]["validate"]["status"] == "completed"
    assert [p.name for p in sets.glob("[0-9]*")] == ["0001"] and (place.parent / ".capture" / "LATEST").exists()
