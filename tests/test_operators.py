"""Hand-worked cases of the operators."""

import pytest
from pyspark.sql import functions as F

from hullscope.functions import severity as sev
from hullscope.functions import text as tx
from hullscope.operators import findings, graph, queue, rules, stats


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_merge(spark):
    ddl = "seq int, scanner string, category string, severity string, id string, title string, package string, version string, cvss double, cves array<string>, references array<string>, target_name string, target_ip string, endpoint string, fixed_version string, location string"
    row = lambda i, s, sv, id_, p, c, ip=None, refs=(), t="nginx": (i, s, "pkg-vuln", sv, id_, "", p, "", c, [id_], list(refs), t, ip, "", "", "")
    got = {r["id"]: r for r in findings.merged(frame(spark, [row(1, "trivy", "high", "CVE-2021-1", "openssl", 7.5, "172.28.0.5"), row(2, "grype", "critical", "CVE-2021-1", "openssl", 9.1, refs=["http://x"]), row(3, "osv", "medium", "CVE-2021-2", "zlib", None)], ddl)).collect()}
    a = got["CVE-2021-1"]
    assert len(got) == 2 and (a.severity, a.cvss, a.found_by, a.n_scanners, a.target_ip, a.references) == ("critical", 9.1, ["grype", "trivy"], 2, "172.28.0.5", ["http://x"])
    assert findings.merged(frame(spark, [row(1, "trivy", "low", "CVE-1", "p", None), row(2, "trivy", "low", "CVE-1", "p", None, t="redis")], ddl)).count() == 2


def test_single_owner_attribution(spark):
    edges = frame(spark, [(1, 0, 1), (2, 1, 2), (3, 1, 3), (4, 4, 3), (5, 2, 5), (6, 3, 6)], "seq int, parent int, child int")
    parents = graph.forest(edges)
    assert {r.child: (r.parent, r.multiparent) for r in parents.collect()}[3] == (4, True)
    pulls = frame(spark, [(0, 100), (1, 10), (2, 50), (3, 500), (5, 20), (6, 30)], "node int, pull long")
    assert [(r.node, r.downstream, r.dependency_weight) for r in graph.attributed(parents, pulls).collect()] == [(0, 80, 3)]
    got = graph.propagation(frame(spark, [("c", 1)], "source string, node int"), parents, pulls).first()
    assert (got.downstream, got.direct) == (3, 1)


def test_layer_chain(spark):
    layers = F.array(F.struct(F.lit("a").alias("digest"), F.lit("").alias("instruction")), F.struct(F.lit("").alias("digest"), F.lit("b").alias("instruction")))
    assert value(spark, tx.layer_chain(layers))[1] == "5b00b81ffc344f03faa2ceb3bbe2532b158352d306c8dc594247d89b6fd1fbf3"


def test_chain_nodes(spark):
    nodes, edges, tops = graph.chain(frame(spark, [("i", ["x", "y"]), ("j", ["x", "y", "z"]), ("k", [])], "image string, ids array<string>"), F.col("ids"))
    assert {r.id: r.images for r in nodes.collect()} == {"x": [], "y": ["i"], "z": ["j"]}
    assert {(r.parent, r.child) for r in edges.collect()} == {("x", "y"), ("y", "z")} and tops.count() == 2


@pytest.mark.parametrize(("vector", "score"), [("CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:N", 7.4), ("CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N", 1.8), ("CVSS:3.1/AV:N/AC:L", None)])
def test_cvss3(spark, vector, score):
    assert value(spark, sev.cvss3(F.lit(vector))) == score


def test_cvss4(spark):
    assert value(spark, sev.cvss4(F.lit("CVSS:4.0/AV:N/AC:L/VC:H/VI:N/VA:N"))) == 9.8
    assert value(spark, sev.cvss4(F.lit("CVSS:4.0/AV:N/AC:L/VC:H"))) is None


@pytest.mark.parametrize(
    ("ref", "parts"),
    [("docker.io/a/b:t@sha256:x", ("a", "b", "t", "sha256:x")), ("docker.io//u/r:t@d", ("", "u/r", "t", "d")), ("nginx", ("library", "nginx", "latest", "")), ("localhost:5000/a/b", ("a", "b", "latest", "")), ("quay.io/a/b:1", ("a", "b", "1", "")), ("a/b", ("a", "b", "latest", ""))],
)
def test_image_refs(spark, ref, parts):
    assert tuple(value(spark, tx.image_ref(F.lit(ref)))) == parts


def test_names(spark):
    assert value(spark, tx.package_name(F.lit("github.com/x/OpenSSL@1.1"))) == "openssl"
    assert value(spark, tx.package_name(F.lit("@scope/pkg"))) == "" and value(spark, tx.package_name(F.lit("@scope/pkg"), strict=False)) == "pkg"
    assert value(spark, tx.reference_key(F.lit("library/alpine:3@sha256:ab"))) == "alpine:3"
    assert value(spark, tx.normal_image(F.lit("a/b"))) == "a/b:latest" and value(spark, tx.slug(F.lit(" a/b:c "))) == "a_b_c"
    assert tuple(value(spark, tx.image_key(F.lit("NS/Repo:Tag@x")))) == ("ns", "repo", "Tag") and value(spark, tx.image_key(F.lit("bare"))) is None
    assert tuple(value(spark, tx.divided_image(F.lit("r.io/n/a:1@sha256:d")))) == ("r.io", "n", "a", "1", "sha256:d")
    assert value(spark, tx.ecosystem_class(F.lit(" Debian:11/x"))) == "os"


def test_times(spark):
    assert value(spark, F.unix_seconds(tx.instant(F.lit('{"$date": "2024-01-01T00:00:00Z"}')))) == value(spark, F.unix_seconds(tx.instant(F.lit("2024-01-01T01:00:00+01:00")))) == 1704067200
    assert value(spark, tx.instant(F.lit("nonsense"))) is None


def test_percentile_conventions(spark):
    rows = frame(spark, [(1, float(v)) for v in (1, 2, 3, 10)], "k int, v double")
    assert round(rows.agg(stats.linear_percentile("v", 0.9)).first()[0], 9) == 7.9
    assert stats.nearest_rank_percentile(rows, ["k"], "v", 0.5, "x").first().x == 2 and stats.upper_percentile(rows, ["k"], "v", 1, 2, "x").first().x == 3
    assert stats.rounded_index_percentile(frame(spark, [(1, v) for v in range(6)], "k int, v int"), ["k"], "v", 0.5, "x").first().x == 2


@pytest.mark.parametrize("n", [1, 7, 10, 23])
def test_deciles_cover_all(spark, n):
    got = {r.decile: r["count"] for r in stats.deciles(spark.range(n).select(F.col("id").alias("v"), "id"), "v", "id").groupBy("decile").count().collect()}
    assert got == {d: c for d in range(10) if (c := (d + 1) * n // 10 - d * n // 10)}


def test_spearman_guards(spark):
    assert stats.spearman(frame(spark, [(1, 2)], "x int, y int"), "x", "y").first().rho == 0.0
    assert stats.spearman(frame(spark, [(1, 5), (2, 5), (3, 5)], "x int, y int"), "x", "y").first().rho == 0.0


def test_queue_state_machine(spark):
    from hullscope.schemas import JOB

    jobs = spark.createDataFrame([], JOB)
    targets = frame(spark, [(1, "a", None, 1.0), (2, "b", None, 9.0), (3, "a", None, 3.0)], "seq int, image string, name string, weight double")
    jobs = queue.seed(jobs, targets, 1.0)
    assert jobs.count() == 2 and queue.seed(jobs, targets, 2.0).count() == 2
    jobs = queue.seed(jobs, frame(spark, [(1, "c", None, 5.0)], targets.schema), 3.0)
    assert [r.image for r in queue.next_pending(jobs, 9).collect()] == ["b", "c", "a"]
    first = jobs.where("image = 'b'").first().id
    for attempt in range(3):
        jobs = spark.createDataFrame(queue.fail(queue.claim(jobs, "w", 1, 10.0), [first], "e", 11.0).collect(), JOB)
        assert jobs.where(F.col("id") == first).first().status == ("failed" if attempt == 2 else "pending")
    jobs = spark.createDataFrame(queue.claim(jobs, "w", 1, 20.0).collect(), JOB)
    assert queue.reclaim_stale(jobs, 21.0, 0.0).where("status = 'running'").count() == 0
    assert queue.reset(jobs, ("failed", "skipped")).where("status = 'pending'").count() == 2
    assert queue.preserved(jobs, jobs) and not queue.preserved(jobs, jobs.where("status <> 'running'"))


def test_pip_words(spark):
    cases = {
        "pip install numpy": [("numpy", [])], "pip install -r req.txt flask==2.0": [("flask", ["==2.0"])], "pip install 'a>=1,<2' b": [("a", [">=1", "<2"]), ("b", [])], "pip install a>=1, <2 b": [("a", [">=1", "<2"]), ("b", [])], "pip install --no-cache-dir -U x": [("x", [])],
    }
    for command, packages in cases.items():
        assert [(p.name, p.limits) for p in value(spark, rules.pip_packages(F.lit(command)))] == packages, command


def test_config_issues(spark):
    issues = lambda app, text: {x.issue: x.severity for x in value(spark, rules.config_issues(F.lit(app), F.lit(text)))}
    assert issues("mongo", "net:\n  bindIp: 0.0.0.0\n") == {"no-authentication": "medium", "binds-all-interfaces": "critical"}
    assert issues("mongo", "security:\n  authorization: enabled\nnet:\n  bindIpAll: true") == {"binds-all-interfaces": "medium"}
    assert issues("redis", "# requirepass x\n") == {"no-authentication": "medium"} and issues("redis", "requirepass x") == {}
    assert issues("couchdb", "[chttpd]\nrequire_valid_user = true") == {} and issues("couchdb", "") == {"no-authentication": "medium"}
    assert issues("mosquitto", "allow_anonymous true") == {"no-authentication": "medium"} and issues("mosquitto", "") == {}
    assert issues("elasticsearch", "xpack.security.enabled: false") == {"no-authentication": "medium"} and issues("elasticsearch", "") == {}
    assert issues("nginx", "autoindex on;") == {"directory-traversal": "low"}
    assert issues("nginx", "location /a/ {\n autoindex on;") == {} and issues("nginx", "alias /x;\nautoindex on;") == {}
    assert value(spark, rules.config_app(F.lit("/etc/redis/redis.conf"))) == "redis"


def test_shards():
    parts = graph.shards("abcdefg", 3)
    assert "".join(parts) == "abcdefg" and len(parts) == 3


def test_run_commands(spark):
    assert value(spark, rules.run_commands(F.lit("use: docker run -it \\\n  nginx\nbye"))) == ["docker run -it \\\n  nginx"]


def test_closures_on_cycles(spark):
    """1 -> 2 -> 3 -> 2 upwards, 4 below 1, and a node that is its own parent: each pair once, self left out."""
    up = {1: 2, 2: 3, 3: 2, 4: 1, 7: 7, 8: 7}
    parents = frame(spark, [(c, p, False) for c, p in up.items()], "child int, parent int, multiparent boolean")

    def ancestors(n):
        out, at = set(), n
        while at in up and up[at] not in out:
            at = up[at]
            out.add(at)
        return out - {n}

    want = sorted((a, n) for n in up for a in ancestors(n))
    assert sorted(map(tuple, graph.closure(parents).collect())) == want
    pulls = frame(spark, [(1, 5), (2, 50), (3, 40), (4, 1), (8, 2), (7, 9)], "node int, pull long")
    assert {r.node: (r.downstream, r.dependency_weight) for r in graph.attributed(parents, pulls).collect()} == {2: (46, 3), 7: (2, 1)}
    with pytest.raises(RuntimeError):
        graph.closure(frame(spark, [(i, i + 1, False) for i in range(9)], "child int, parent int, multiparent boolean"), max_depth=3)


@pytest.mark.parametrize(("instruction", "ports"), [("EXPOSE map[80/tcp:{} 443/udp:{}]", ["80/tcp", "443/udp"]), ("EXPOSE [8080/tcp]", ["8080/tcp"]), ("EXPOSE 80 443", ["80", "443"]), ("/bin/sh -c #(nop)  EXPOSE 5432", ["5432"]), ("RUN sleep 80", []), ("ENV A=1 2", []), (None, [])])
def test_exposed_ports(spark, instruction, ports):
    assert value(spark, tx.exposed_ports(F.lit(instruction))) == ports


@pytest.mark.parametrize(("path", "app"), [("/etc/mongodb.conf", "mongo"), ("/etc/mongod.conf", "mongo"), ("mongo.conf", "mongo"), ("/opt/couchdb/etc/local.d/a.ini", "couchdb"), ("/etc/xnginx.conf", "nginx"), ("/etc/hosts", None)])
def test_config_files(spark, path, app):
    assert value(spark, rules.config_app(F.lit(path))) == app


@pytest.mark.parametrize(("lines", "found"), [(["location / {", "autoindex on;"], True), (["location /files/ {", "autoindex on;"], False), (["alias /x;", "autoindex on;"], False), (["autoindex on;"], True), ([], False)])
def test_listed_directories(spark, lines, found):
    assert value(spark, rules.lists_directories(F.array(*map(F.lit, lines)).cast("array<string>"))) is found


def test_queue_transitions(spark):
    from hullscope.schemas import JOB

    new = queue.seed(spark.createDataFrame([], JOB), frame(spark, [(1, "a", None, 2.0), (2, "b", None, 3.0), (3, "a", None, 9.0)], "seq int, image string, name string, weight double"), 1.0)
    state = lambda df: {r["image"]: r["status"] for r in df.collect()}
    run = queue.claim(new, "w", 2, 5.0).cache()
    ids = {r["image"]: r["id"] for r in run.collect()}
    assert state(run) == {"a": "running", "b": "running"}
    assert {r["image"]: r["heartbeat_at"] for r in queue.heartbeat(run, [ids["a"]], 9.0).collect()} == {"a": 9.0, "b": 5.0}
    done = queue.complete(run, [ids["a"]], 10.0)
    assert state(done) == {"a": "done", "b": "running"} and done.where("image = 'a'").first()["finished_at"] == 10.0
    assert state(queue.skip(run, [ids["b"]], "why", 11.0)) == {"a": "running", "b": "skipped"}
    assert state(queue.heartbeat(done, [ids["a"]], 12.0)) == {"a": "done", "b": "running"}
    assert state(queue.reset(done, ("done",))) == {"a": "pending", "b": "running"}
    reports = queue.upserted(frame(spark, [("a", 1), ("b", 2)], "image string, n int"), frame(spark, [("b", 3), ("c", 4)], "image string, n int"))
    assert sorted(map(tuple, reports.collect())) == [("a", 1), ("b", 3), ("c", 4)]


@pytest.mark.parametrize(("x", "shown"), [(7.0, "7"), (1234.0, "1.2k"), (5.6e6, "5.6M"), (7.89e9, "7.9B")])
def test_short_numbers(spark, x, shown):
    assert value(spark, tx.short_number(F.lit(x))) == shown


def test_legal_digests(spark):
    assert value(spark, tx.legal_digest(F.lit("sha256:" + "a" * 64))) and not value(spark, tx.legal_digest(F.lit("sha256:" + "a" * 63)))
