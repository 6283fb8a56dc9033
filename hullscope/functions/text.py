"""Names, references, URLs, packages and identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CVE = r"(?i)CVE-\d{4}-\d{4,7}"
#: Ecosystems of operating systems and of languages.
OS_ECOSYSTEMS = ("alma", "alpine", "alpm", "amazon", "apk", "arch", "azurelinux", "centos", "chainguard", "deb", "debian", "distroless", "mageia", "mariner", "openeuler", "oracle", "photon", "redhat", "rhel", "rocky", "rpm", "sles", "suse", "ubuntu", "wolfi")
LANGUAGE_ECOSYSTEMS = ("binary", "cargo", "composer", "conan", "crates.io", "dotnet", "gem", "go", "go-module", "gobinary", "golang", "java", "java-archive", "maven", "node", "node-pkg", "npm", "nuget", "packagist", "php-composer", "php-pear", "pypi", "python", "python-pkg", "ruby", "rubygems", "rust-crate")


def filled(value: Column, default: Column | str) -> Column:
    """value unless null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def ecosystem(value: Column) -> Column:
    """Lower case, what stands before ':' and then before '/'."""
    return F.split_part(F.split_part(F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit(":"), F.lit(1)), F.lit("/"), F.lit(1))


def ecosystem_class(value: Column) -> Column:
    own = ecosystem(value)
    return F.when(own.isin(*OS_ECOSYSTEMS), "os").when(own.isin(*LANGUAGE_ECOSYSTEMS), "lang").otherwise("other")


def package_name(value: Column, strict: bool = True) -> Column:
    """Last path part before '@', lower case. A scoped name ('@scope/x') is empty if strict, else keeps its last part."""
    own = F.coalesce(value, F.lit(""))
    if not strict:
        own = F.regexp_replace(own, "^@", "")
    return F.lower(F.element_at(F.split(F.split_part(own, F.lit("@"), F.lit(1)), "/"), -1))


def image_key(image: Column) -> Column:
    """struct(ns, repo, tag) of NS/REPO:TAG[@digest], names in lower case; null where there is no ':'."""
    bare = F.trim(F.split_part(image, F.lit("@"), F.lit(1)))
    name, tag = F.regexp_extract(bare, r"^(.*):([^:]*)$", 1), F.regexp_extract(bare, r"^(.*):([^:]*)$", 2)
    ns = F.when(name.contains("/"), F.split_part(name, F.lit("/"), F.lit(1))).otherwise("library")
    repo = F.when(name.contains("/"), F.regexp_extract(name, r"^[^/]*/(.*)$", 1)).otherwise(name)
    return F.when(bare.contains(":"), F.struct(F.lower(ns).alias("ns"), F.lower(repo).alias("repo"), tag.alias("tag")))


def image_ref(ref: Column) -> Column:
    """struct(ns, repo, tag, digest) of a graph reference: digest after the first '@', tag after the last ':' that no '/'
    follows, the registry dropped if it is docker.io or looks like a host; a bare name is in library; ns may be empty."""
    digest = F.coalesce(F.regexp_extract(ref, r"^[^@]*@(.*)$", 1), F.lit(""))
    body = F.split_part(ref, F.lit("@"), F.lit(1))
    tagged = body.rlike(r":[^/:]*$")
    tag = F.when(tagged, F.regexp_extract(body, r":([^/:]*)$", 1)).otherwise("latest")
    name = F.when(tagged, F.regexp_replace(body, r":[^/:]*$", "")).otherwise(body)
    first = F.split_part(name, F.lit("/"), F.lit(1))
    hosted = first.contains(".") | first.contains(":") | (first == "localhost")
    rest = F.when(name.startswith("docker.io/"), F.substr(name, F.lit(11))).when(name.contains("/") & hosted, F.regexp_extract(name, r"^[^/]*/(.*)$", 1)).otherwise(name)
    ns = F.when(rest.contains("/"), F.split_part(rest, F.lit("/"), F.lit(1))).otherwise("library")
    repo = F.when(rest.contains("/"), F.regexp_extract(rest, r"^[^/]*/(.*)$", 1)).otherwise(rest)
    return F.struct(ns.alias("ns"), repo.alias("repo"), tag.alias("tag"), digest.alias("digest"))


def divided_image(name: Column) -> Column:
    """struct(registry, ns, repo, tag, digest) by the other rule: one '@' at most and one or two ':'; parts by the count of '/'."""
    digest = F.when(F.size(F.split(name, "@")) == 2, F.split_part(name, F.lit("@"), F.lit(2))).otherwise("")
    body = F.split_part(name, F.lit("@"), F.lit(1))
    colons = F.size(F.split(body, ":")) - 1
    tag = F.when(colons.between(1, 2) & body.rlike(r":[^/:]*$"), F.regexp_extract(body, r":([^/:]*)$", 1)).otherwise("")
    path = F.split(F.when(tag != "", F.regexp_replace(body, r":[^/:]*$", "")).otherwise(body), "/")
    n = F.size(path)
    return F.struct(
        F.when(n >= 3, path[0]).otherwise("docker.io").alias("registry"),
        F.when(n >= 3, path[1]).when(n == 2, path[0]).otherwise("library").alias("ns"),
        F.when(n >= 3, F.array_join(F.slice(path, 3, 100), "/")).when(n == 2, path[1]).otherwise(path[0]).alias("repo"),
        tag.alias("tag"),
        digest.alias("digest"),
    )


def repository_name(name: Column) -> Column:
    """struct(ns, repo): split at the first '/', library if there is none."""
    has = name.contains("/")
    return F.struct(F.when(has, F.split_part(name, F.lit("/"), F.lit(1))).otherwise("library").alias("ns"), F.when(has, F.regexp_extract(name, r"^[^/]*/(.*)$", 1)).otherwise(name).alias("repo"))


def reference_key(image: Column) -> Column:
    """Before '@', trimmed, without a leading 'library/'."""
    return F.regexp_replace(F.trim(F.split_part(image, F.lit("@"), F.lit(1))), "^library/", "")


def is_official(namespace: Column) -> Column:
    return F.lower(F.trim(F.coalesce(namespace, F.lit("")))).isin("", "library")


def queue_image(ns: Column, repo: Column, tag: Column, digest: Column) -> Column:
    """[ns/]name:tag@digest, library left out."""
    return F.concat(F.when(is_official(ns), F.lit("")).otherwise(F.concat(ns, F.lit("/"))), repo, F.lit(":"), tag, F.lit("@"), digest)


def normal_image(image: Column) -> Column:
    """':latest' is added where the last path part has neither ':' nor '@'."""
    own = F.trim(image)
    return F.when(F.element_at(F.split(own, "/"), -1).rlike("[:@]"), own).otherwise(F.concat(own, F.lit(":latest")))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"[^a-zA-Z0-9._-]+", "_"), r"^_+|_+$", "")


def cves_in(value: Column) -> Column:
    """Sorted distinct CVE identifiers in a text, upper case."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(f"({CVE})"), F.lit(1)), F.upper)))


def cve_year(value: Column) -> Column:
    """The year of an identifier that begins like a CVE; null otherwise."""
    return F.nullif(F.regexp_extract(value, r"(?i)^CVE-(\d{4})-\d+", 1), F.lit("")).cast("int")


def endpoint(url: Column) -> Column:
    """Host and port after the scheme."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)


def without_tags(html: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "), F.lit("&amp;"), F.lit("&")))


def exposed_ports(instruction: Column) -> Column:
    """Ports of 'EXPOSE map[80/tcp:{}]', 'EXPOSE [80/tcp]' or 'EXPOSE 80 443'; none of any other instruction."""
    listed = F.regexp_extract(F.coalesce(instruction, F.lit("")), r"(?i)(?:^|\s)EXPOSE\s+(?:map)?\[?([^\]]*)", 1)
    return F.regexp_extract_all(listed, F.lit(r"(?:^|\s)(\d+(?:/[a-z]+)?)"), F.lit(1))


def short_number(x: Column) -> Column:
    """1.2k, 3.4M, 5.6B."""
    return F.when(x >= 1e9, F.format_string("%.1fB", x / 1e9)).when(x >= 1e6, F.format_string("%.1fM", x / 1e6)).when(x >= 1e3, F.format_string("%.1fk", x / 1e3)).otherwise(F.format_string("%.0f", x))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0))


def legal_digest(digest: Column) -> Column:
    return (F.length(digest) == 71) & digest.startswith("sha256:")


def signature_tag(tag: Column) -> Column:
    return tag.rlike(r"^sha256-[0-9a-f]{64}\.(sig|att)$")


def instant(value: Column) -> Column:
    """ISO text with Z, an offset or none (UTC), or a {"$date": ...} wrapper."""
    bare = F.coalesce(F.get_json_object(F.when(value.startswith("{"), value), "$.$date"), value)
    return F.try_to_timestamp(bare)


def age_days(at: Column, as_of: Column) -> Column:
    return F.bround((F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(86_400e6), 1)


def wide_integer(value: Column) -> Column:
    """struct(high, low) of a split 64-bit number."""
    return value["high"].cast("bigint") * F.lit(1 << 32) + value["low"].cast("bigint")


def layer_chain(layers: Column) -> Column:
    """Node ids of an image's layers: each is sha256 of the id before it and the sha256 of the layer's digest, or instruction if that is empty."""
    own = F.transform(layers, lambda x: F.sha2(F.coalesce(F.nullif(x["digest"], F.lit("")), x["instruction"], F.lit("")).cast("binary"), 256))
    return F.aggregate(own, F.array().cast("array<string>"), lambda ids, h: F.concat(ids, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(ids, F.lit(-1)), F.lit("")), h).cast("binary"), 256))))
