"""Parsers of build files, logs and probe output over fixtures that both engines read from one list."""

from __future__ import annotations

from lithic.plans.catalog import query
from lithic.sources import config

GO_MOD = [("a/go.mod", "module code.lan/team/a\n\ngo 1.22\n\nrequire (\n\tcode.lan/x/y v1.2.3\n\tcode.lan/z/w v0.1.0 // indirect\n)\n\nrequire golang.org/x/text v0.3.0\n"), ("b/go.mod", "module b.example/m\n"), ("c/go.mod", "go 1.21\n")]
PACKAGE = [("package.json", '{"name": "web", "version": "2.0.1", "dependencies": {"react": "^18.0.0", "zod": "3.1.0"}, "devDependencies": {"vite": "5.0.0"}}'), ("bad.json", "{not json")]
DOCKER = [("Dockerfile", "FROM registry.lan/base/forge:7 AS smithy\nRUN x\nFROM tinybox:2.4\nFROM tinybox:2.4 as again\nEXPOSE 7001\nexpose 7002/udp\n")]
POM = [("pom.xml", "<project><groupId>g</groupId><artifactId>a</artifactId><version>1</version><dependencies><dependency><groupId>gauge</groupId><artifactId>gauge</artifactId><version>2.2</version><scope>test</scope></dependency><dependency><groupId>net.lichen</groupId><artifactId>moss-base</artifactId><version>8.0.3</version></dependency></dependencies></project>")]
GRADLE = [("build.gradle", "dependencies {\n  implementation 'net.lichen:moss-base:8.0.3'\n  testImplementation \"gauge:gauge:2.2\"\n  // api 'a:b:c'\n  api 'net.fern:y:1.0'\n}\n")]
LOG = [("log", "COMMIT:abc123|Ann|ann@x.org|fix: a | b\n\nsrc/a.go\nsrc/b.go\nCOMMIT:bad\nCOMMIT:def456|Bob|bob@x.org|second\nREADME.md\n")]
PROBE = [("v.mp4", '{"streams": [{"codec_type": "audio", "codec_name": "aac", "sample_rate": "44100", "channels": 2}, {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "r_frame_rate": "30000/1001"}], "format": {"duration": "12.5", "bit_rate": "128000"}}')]


def files(spark, rows):
    return spark.createDataFrame(rows, "file string, text string")


def values(columns: str, rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({columns})"


@query("parse_go_mod", values("file, module, go, name, version, indirect", [
    ("a/go.mod", "code.lan/team/a", "1.22", "code.lan/x/y", "v1.2.3", False), ("a/go.mod", "code.lan/team/a", "1.22", "code.lan/z/w", "v0.1.0", True),
    ("a/go.mod", "code.lan/team/a", "1.22", "golang.org/x/text", "v0.3.0", False), ("b/go.mod", "b.example/m", None, None, None, None)]))
def parse_go_mod(spark, d):
    return config.go_mod(files(spark, GO_MOD))


@query("parse_package_json", values("file, package, package_version, name, version, dev", [("package.json", "web", "2.0.1", "react", "^18.0.0", False), ("package.json", "web", "2.0.1", "zod", "3.1.0", False), ("package.json", "web", "2.0.1", "vite", "5.0.0", True)]))
def parse_package_json(spark, d):
    return config.package_json(files(spark, PACKAGE))


@query("parse_dockerfile", values("file, what, value, ord", [("Dockerfile", "image", "registry.lan/base/forge:7", 0), ("Dockerfile", "image", "tinybox:2.4", 2), ("Dockerfile", "port", "7001", 4), ("Dockerfile", "port", "7002/udp", 5)]))
def parse_dockerfile(spark, d):
    return config.dockerfile(files(spark, DOCKER))


@query("parse_pom", values("file, group_id, artifact_id, version, scope", [("pom.xml", "gauge", "gauge", "2.2", "test"), ("pom.xml", "net.lichen", "moss-base", "8.0.3", "compile")]))
def parse_pom(spark, d):
    return config.pom(files(spark, POM))


@query("parse_gradle", values('file, configuration, "group", name, version', [("build.gradle", "implementation", "net.lichen", "moss-base", "8.0.3"), ("build.gradle", "testImplementation", "gauge", "gauge", "2.2"), ("build.gradle", "api", "net.fern", "y", "1.0")]))
def parse_gradle(spark, d):
    return config.gradle(files(spark, GRADLE))


@query("parse_git_log", values("file, sha, author, email, subject, files", [("log", "abc123", "Ann", "ann@x.org", "fix: a | b", "src/a.go,src/b.go"), ("log", "def456", "Bob", "bob@x.org", "second", "README.md")]))
def parse_git_log(spark, d):
    return config.git_log(files(spark, LOG))


@query("probe_video", values("file, codec, width, height, channels, bitrate", [("v.mp4", "h264", 1920, 1080, None, 128000)]))
def probe_video(spark, d):
    return config.probe(files(spark, PROBE), "video").select("file", "codec", "width", "height", "channels", "bitrate")


@query("probe_audio", "SELECT file, codec, sample_rate, channels, CAST(duration AS DOUBLE) AS duration FROM (" + values("file, codec, sample_rate, channels, duration", [("v.mp4", "aac", 44100, 2, 12.5)]) + ")")
def probe_audio(spark, d):
    return config.probe(files(spark, PROBE), "audio").select("file", "codec", "sample_rate", "channels", "duration")
