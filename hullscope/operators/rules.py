"""Rules over texts: pattern rules, install commands in image instructions, configuration checks, and layers that override each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns that decide which part of a text is a command or an address; other ones would find other texts.
RUN_COMMAND = r"docker\s+run.*(?:\\[\n\r].+)*."
URL = r"\s(https?://\S*)"
INSTALL = r"({tool}\s+install\s+.*?)(?:&&|\n|$)"
FETCH = r"(wget\s+(?s:.)*?)(?:&&|$)"
ADDED = r"ADD\s+.*(https?://\S+)"


def matches(texts: DataFrame, rules: list[tuple[str, str, str]], key: str, text: str) -> DataFrame:
    """(key, rule, severity, match): every match of every rule (name, pattern, severity). One pass, the rules are literals."""
    def of(name: str, pattern: str, severity: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), m.alias("match")))

    found = [of(*r) for r in rules]
    return texts.where(F.col(text).isNotNull()).select(key, F.explode(F.concat(*found)).alias("m")).select(key, "m.*")


def run_commands(text: Column) -> Column:
    """Recommended 'docker run' commands of a description, continued lines included."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN_COMMAND), F.lit(0))


def commands(instruction: Column, tool: str) -> Column:
    """Whole 'pip install ...' or 'npm install ...' commands, each up to '&&' or the line's end; 'wget ...' up to '&&' or the text's end."""
    pattern = FETCH if tool == "wget" else INSTALL.replace("{tool}", tool)
    return F.regexp_extract_all(F.coalesce(instruction, F.lit("")), F.lit(pattern), F.lit(1))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(1))


def added_urls(instruction: Column) -> Column:
    """URLs of an ADD instruction."""
    return F.when(instruction.rlike(ADDED), urls(instruction)).otherwise(F.array().cast("array<string>"))


#: Options of 'pip install' that take the next word, by the name they are kept under.
PIP_VALUE_OPTIONS = {
    "-r": "requirement", "--requirement": "requirement", "-c": "constraint", "--constraint": "constraint", "-e": "editable", "--editable": "editable", "-t": "target", "--target": "target", "-b": "build", "--build": "build",
    "--platform": "platform", "--python-version": "python-version", "--implementation": "implementation", "--abi": "abi", "--root": "root", "--prefix": "prefix", "--src": "src", "--upgrade-strategy": "upgrade-strategy",
    "--install-option": "install-option", "-C": "config-settings", "--config-settings": "config-settings", "--global-option": "global-option", "--no-binary": "no-binary", "--only-binary": "only-binary",
    "--progress-bar": "progress-bar", "--root-user-action": "root-user-action", "--report": "report", "-i": "index-url", "--index-url": "index-url", "--extra-index-url": "extra-index-url", "-f": "find-links", "--find-links": "find-links",
}
_SPEC = r"^(.*?)((?:~=|===?|!=|<=|>=|<|>).*)$"


def pip_packages(command: Column) -> Column:
    """array<struct<name, limits>> of a 'pip install' command.

    A fold over its words with the state (packages, what the next word is): an option that takes a value swallows the next
    word, a version list that ends in a comma goes on in the next word.
    """
    kind = "array<struct<name:string,limits:array<string>>>"
    words = F.transform(F.filter(F.split(F.regexp_replace(command, r"^pip\s+install\s+", ""), " "), lambda w: w != ""), lambda w: F.regexp_replace(w, "^[\"']+|[\"']+$", ""))
    start = F.struct(F.array().cast(kind).alias("packages"), F.lit("").alias("expects"))

    def step(state: Column, w: Column) -> Column:
        option = w.startswith("-")
        takes = w.isin(*PIP_VALUE_OPTIONS)
        parts = F.split(w, ",")
        head, limit = F.regexp_extract(parts[0], _SPEC, 1), F.regexp_extract(parts[0], _SPEC, 2)
        more = F.filter(F.slice(parts, 2, 1000), lambda x: x != "")
        own = F.struct(F.when(limit != "", head).otherwise(parts[0]).alias("name"), F.when(limit != "", F.concat(F.array(limit), more)).otherwise(F.array().cast("array<string>")).alias("limits"))
        open_ = (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
        last = F.element_at(state["packages"], -1)
        longer = F.concat(F.slice(state["packages"], F.lit(1), F.size(state["packages"]) - 1), F.array(F.struct(last["name"].alias("name"), F.concat(last["limits"], F.filter(parts, lambda x: x != "")).alias("limits"))))
        packages = F.when(option | (state["expects"] == "value"), state["packages"]).when(state["expects"] == "limit", longer).otherwise(F.concat(state["packages"], F.array(own)))
        expects = F.when(takes, "value").when(option, state["expects"]).when(state["expects"] == "value", "").when(open_, "limit").otherwise("")
        return F.struct(packages.alias("packages"), expects.alias("expects"))

    return F.aggregate(words, start, step, lambda s: s["packages"])


def npm_packages(command: Column) -> Column:
    """Words of an 'npm install' command that aren't flags."""
    return F.filter(F.split(F.regexp_replace(command, r"^npm\s+install\s+", ""), " "), lambda w: (w != "") & ~w.startswith("-"))


def installed_content(layers: DataFrame, key: str, instruction: str) -> DataFrame:
    """(key, kind, name, version) of everything that an instruction installs or fetches."""
    text = F.col(instruction)
    none = F.array().cast("array<string>")
    row = lambda kind, name, version: F.struct(F.lit(kind).alias("kind"), name.alias("name"), version.alias("version"))
    pip = F.flatten(F.transform(commands(text, "pip"), lambda c: F.transform(pip_packages(c), lambda p: row("pip", p["name"], F.array_join(p["limits"], ",")))))
    npm = F.flatten(F.transform(commands(text, "npm"), lambda c: F.transform(npm_packages(c), lambda p: row("npm", p, F.lit("")))))
    wget = F.flatten(F.transform(commands(text, "wget"), lambda c: F.transform(urls(c), lambda u: row("wget", u, F.lit("")))))
    add = F.transform(F.coalesce(added_urls(text), none), lambda u: row("add", u, F.lit("")))
    return layers.select(key, F.explode(F.concat(pip, npm, wget, add)).alias("x")).select(key, "x.*")


#: Configuration files by path pattern, in the order in which they are tried.
CONFIG_FILES = [("mongo", r"mongo(d|db)?\.conf$"), ("couchdb", r"(default|local)(\.d/\S+)?\.ini$"), ("redis", r"redis\.conf$"), ("nginx", r"nginx\.conf$"), ("mosquitto", r"mosquitto\.conf$"), ("elasticsearch", r"elasticsearch\.yml$")]
#: Severity and score of the three kinds of issue; listening everywhere without authentication is worst.
UNAUTHORISED, EVERYWHERE, EVERYWHERE_OPEN, TRAVERSAL = ("medium", 5.0), ("medium", 4.0), ("critical", 10.0), ("low", 3.0)


def config_app(path: Column) -> Column:
    return reduce(lambda acc, x: acc.when(path.rlike(x[1]), x[0]), CONFIG_FILES, F).otherwise(F.lit(None).cast("string"))


def lists_directories(lines: Column) -> Column:
    """nginx: is 'autoindex on' met in a location whose path doesn't end in '/', or in none, before any alias?"""
    start = F.struct(F.lit(False).alias("closed"), F.lit(False).alias("over"), F.lit(False).alias("found"))

    def step(state: Column, line: Column) -> Column:
        place = F.regexp_extract(line, r"location\s+(\S+)", 1)
        closed = F.when(place != "", (F.length(place) > 1) & place.endswith("/")).otherwise(state["closed"])
        found = ~state["over"] & ~closed & ~line.rlike(r"alias\s+\S+") & line.rlike(r"autoindex\s+on")
        return F.struct(closed.alias("closed"), (state["over"] | found | line.rlike(r"alias\s+\S+")).alias("over"), (state["found"] | found).alias("found"))

    return F.aggregate(lines, start, step, lambda s: s["found"])


def config_issues(app: Column, text: Column) -> Column:
    """array<struct<issue, severity, score>> of one configuration file; lines that start with '#' don't count.

    Without authentication: mongo unless authorization is enabled, couchdb unless a valid user is required, redis without a
    password, mosquitto that allows anonymous clients, elasticsearch with security switched off (on by default).
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\r?\\n"), lambda x: F.trim(x)), lambda x: ~x.startswith("#"))
    has = lambda p: F.exists(lines, lambda x: x.rlike(p))
    open_ = (
        F.when(app == "mongo", ~has("^authorization\\s*:\\s*[\"']?enabled[\"']?\\s*(#.*)?$"))
        .when(app == "couchdb", ~has(r"(?i)^require_valid_user\s*=\s*(true|1|yes|on|t|y)\s*$"))
        .when(app == "redis", ~has(r"requirepass\s+\S+"))
        .when(app == "mosquitto", has(r"allow_anonymous\s+true"))
        .when(app == "elasticsearch", has(r"^xpack\.security\.enabled\s*:\s*false\b"))
        .otherwise(F.lit(False))
    )
    everywhere = (app == "mongo") & (has(r"^bindIp\s*:.*(0.0.0.0|::)") | has(r"^bindIpAll\s*:\s*true\b"))
    issue = lambda when, name, grade: F.when(when, F.struct(F.lit(name).alias("issue"), F.lit(grade[0]).alias("severity"), F.lit(grade[1]).alias("score")))
    found = F.array(issue(open_, "no-authentication", UNAUTHORISED), issue(everywhere & ~open_, "binds-all-interfaces", EVERYWHERE), issue(everywhere & open_, "binds-all-interfaces", EVERYWHERE_OPEN), issue((app == "nginx") & lists_directories(lines), "directory-traversal", TRAVERSAL))
    return F.filter(found, lambda x: x.isNotNull())


def topmost(rows: DataFrame, image: str = "image", path: str = "path", layer: str = "layer") -> DataFrame:
    """Rows of the highest layer that has a path, all of that layer's rows for it: a later layer overrides the file."""
    return rows.withColumn("__r", F.rank().over(Window.partitionBy(image, path).orderBy(F.col(layer).desc()))).where("__r = 1").drop("__r")


def best_platform(images: DataFrame, key: str, architecture: str, os: str, variant: str = "") -> DataFrame:
    """One image a key: all three match, else architecture and os, else architecture, else the first by digest."""
    score = F.when((F.col("architecture") == architecture) & (F.col("os") == os) & (F.coalesce("variant", F.lit("")) == variant), 3).when((F.col("architecture") == architecture) & (F.col("os") == os), 2).when(F.col("architecture") == architecture, 1).otherwise(0)
    return images.withColumn("__s", score).withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("__s").desc(), "digest"))).where("__r = 1").drop("__r", "__s")
