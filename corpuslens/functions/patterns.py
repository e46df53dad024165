"""Patterns, translated and checked once on the driver; rows only meet the regular expressions that come out."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.sources.shared import new_path


class PatternError(ValueError):
    """A pattern that can't be used."""


def _classes(glob: str, at: int) -> tuple[str, int]:
    """The character class that begins at glob[at] == '[', and where it ends."""
    end = glob.find("]", at + 2 if glob[at + 1 : at + 2] in ("!", "^", "]") else at + 1)
    if glob[at + 1 : at + 3] in ("!]", "^]"):
        end = glob.find("]", at + 3)
    if end < 0:
        raise PatternError(f"unclosed class in {glob!r}")
    inside = glob[at + 1 : end]
    negated = inside[:1] in ("!", "^")
    body = re.sub(r"([\\\[\]^&~])", r"\\\1", inside[negated:])
    return f"[{'^' * negated}{body}]", end + 1


def _alternatives(glob: str) -> list[str]:
    """Globs without {a,b}; nested ones too."""
    if (start := glob.find("{")) < 0:
        return [glob]
    depth, parts, last = 0, [], start + 1
    for k in range(start, len(glob)):
        if glob[k] == "{":
            depth += 1
        elif glob[k] == "," and depth == 1:
            parts.append(glob[last:k])
            last = k + 1
        elif glob[k] == "}":
            depth -= 1
            if not depth:
                parts.append(glob[last:k])
                return [x for p in parts for x in _alternatives(glob[:start] + p + glob[k + 1 :])]
    raise PatternError(f"unclosed alternatives in {glob!r}")


def _translate(glob: str, star: str, one: str) -> str:
    out, k = [], 0
    while k < len(glob):
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out.append("(?:.*/)?")
            k += 3
        elif glob.startswith("/**", k) and k + 3 == len(glob):
            out.append("/.*")
            k += 3
        elif glob[k] == "*":
            while glob[k : k + 1] == "*":
                k += 1
            out.append(star)
        elif glob[k] == "?":
            out.append(one)
            k += 1
        elif glob[k] == "[":
            part, k = _classes(glob, k)
            out.append(part)
        elif glob[k] == "\\" and k + 1 < len(glob):
            out.append(re.escape(glob[k + 1]))
            k += 2
        else:
            out.append(re.escape(glob[k]))
            k += 1
    return "".join(out)


def path_glob(glob: str) -> str:
    """Anchored regex of a glob whose * and ? cross slashes."""
    return "(?s)^(?:" + "|".join(_translate(g, ".*", ".") for g in _alternatives(glob)) + ")$"


def ignore_glob(glob: str) -> str:
    """Anchored regex of a glob in the dialect of ignore files: * stays in a name; without a slash it matches names at any depth."""
    anchored = "/" in glob.rstrip("/")
    out = [_translate(g.lstrip("/"), "[^/]*", "[^/]") for g in _alternatives(glob.rstrip("/") + "/**" * glob.endswith("/"))]
    return "(?s)^" + ("" if anchored else "(?:.*/)?") + "(?:" + "|".join(out) + ")$"


def exclude_regex(globs) -> str | None:
    """One regex for all globs; a glob that ends in /** leaves out its directory too."""
    every = sorted({g for glob in globs for g in (glob, *([glob[:-3]] if glob.endswith("/**") else []))})
    return "|".join(f"(?:{path_glob(g)})" for g in every) or None


def excluded(path: Column, globs) -> Column:
    regex = exclude_regex(globs)
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(regex) if regex else F.lit(False)


def included(path: Column, globs) -> Column:
    """True where any glob matches, or where there are none."""
    globs = list(globs or [])
    return path.rlike("|".join(f"(?:{ignore_glob(g)})" for g in globs)) if globs else F.lit(True)


def path_matches(rel_path: Column, pattern: str) -> Column:
    """Of './' and the path: a glob where the pattern has * or ?, else a substring; a bad glob matches nothing."""
    subject = F.concat(F.lit("./"), rel_path)
    if not re.search(r"[*?]", pattern):
        return subject.contains(pattern)
    try:
        return subject.rlike(path_glob(pattern))
    except PatternError:
        return F.lit(False)


def check_regex(spark: SparkSession, pattern: str) -> None:
    """Raises PatternError for a regex that Spark's own engine refuses, before any row is read."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise PatternError(f"bad pattern {pattern!r}") from e


# Patterns as data: thousands of globs meet paths by equal keys.

_PLAIN = r"[^*?\[{/\\\\]+"
KEYS = "glob string, one int, kind string, key string, regex string"


def _class_with_slash(glob: str) -> bool:
    k = 0
    while k < len(glob):
        if glob[k] == "[":
            end = _classes(glob, k)[1]
            if "/" in glob[k:end]:
                return True
            k = end
        else:
            k += 2 if glob[k] == "\\" else 1
    return False


def _literal_keys(glob: str) -> list[tuple[str, str]]:
    """(kind, key) of all plain text in a glob whose place in a path is known: whole parts, and how other parts begin and end."""
    if _class_with_slash(glob):
        return []
    out = []
    for part in glob.split("/"):
        if re.fullmatch(_PLAIN, part):
            out.append(("part", part))
            continue
        begin, end = re.match(r"[^*?\[{\\]+", part), re.search(r"[^*?\[\]{\\]+$", part)
        out += [(kind, m[0]) for kind, m in (("begin", begin), ("end", end)) if m]
    return out


def glob_keys(glob: str) -> list[tuple[int, str, str, str | None]]:
    """(one, kind, key, regex) of an exclude glob: its alternatives are numbered, and each path that one matches has every key of it among path_keys; the regex, where there is one, decides."""
    out, n = [], 0
    for g in (glob, *([glob[:-3]] if glob.endswith("/**") else [])):
        for one in _alternatives(g):
            simple = [("name", rf"\*\*/({_PLAIN})"), ("ending", rf"\*\*/\*(\.{_PLAIN})"), ("folder", rf"\*\*/({_PLAIN})/\*\*"), ("top", rf"({_PLAIN})/\*\*")]
            found = [(n, kind, m[1], None) for kind, pattern in simple if (m := re.fullmatch(pattern, one))]
            out += found or [(n, kind, key, path_glob(one)) for kind, key in _literal_keys(one) or [("any", "")]]
            n += 1
    return out


def keyed_globs(globs: DataFrame) -> DataFrame:
    """glob, one, kind, key, regex of a table of globs (glob); a glob that can't be used is an error."""
    schema = pa.schema([(c, pa.int32() if c == "one" else pa.string()) for c in ("glob", "one", "kind", "key", "regex")])

    def run(it):
        for batch in it:
            rows = [{"glob": g, "one": one, "kind": kind, "key": key, "regex": regex} for g in batch["glob"].to_pylist() if g for one, kind, key, regex in glob_keys(g)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return globs.select("glob").distinct().mapInArrow(run, KEYS)


def path_keys(path: Column, begins: list[int] = (), ends: list[int] = ()) -> Column:
    """(kind, key) of all that a keyed glob may meet a path by; beginnings and ends of parts are those of the given lengths."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    dots = F.split(name, r"\.")
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    endings = F.transform(F.sequence(F.lit(2), F.size(dots)), lambda k: pair("ending", F.concat(F.lit("."), F.array_join(F.slice(dots, k, F.size(dots)), "."))))
    none = F.slice(F.array(pair("name", name)), 2, 1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    cut = lambda kind, side, n: F.transform(F.filter(parts, lambda x: F.length(x) >= n), lambda x: pair(kind, side(x, F.lit(n))))
    return F.array_distinct(
        F.concat(
            F.array(pair("name", name)),
            F.when(F.size(dots) > 1, endings).otherwise(none),
            F.transform(folders, lambda x: pair("folder", x)),
            F.when(F.size(parts) > 1, F.array(pair("top", F.element_at(parts, 1)))).otherwise(none),
            F.transform(parts, lambda x: pair("part", x)),
            *(cut("begin", F.left, n) for n in begins),
            *(cut("end", F.right, n) for n in ends),
        )
    )


def _stored(df: DataFrame, name: str) -> DataFrame:
    at = new_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def without_excluded(files: DataFrame, globs: DataFrame) -> DataFrame:
    """Files (rel_path, ...) that no glob of a table (glob) excludes, as `excluded` would have it.

    Paths and globs meet by equal names, endings, folders, parts, or beginnings and ends of parts: each glob by its rarest, counted on the paths. Only globs with stars elsewhere are
    checked by their regex, on the paths that they meet. Globs without any plain text in a known place, such as `*foo*`, are one regex for all paths: there should be few.
    """
    keyed = _stored(keyed_globs(globs), "globs")
    path = F.replace("rel_path", F.lit("\\"), F.lit("/"))
    loose = [r["regex"] for r in keyed.where("kind = 'any'").select("regex").distinct().orderBy("regex").collect()]
    lengths = keyed.where("kind in ('begin', 'end')").select("kind", F.length("key").alias("n")).distinct().orderBy("n").collect()  # a name is 255 letters at most
    begins, ends = ([r["n"] for r in lengths if r["kind"] == kind] for kind in ("begin", "end"))
    paths = files.select("rel_path").distinct()
    seen = paths.select("rel_path", path.alias("_path"), F.explode(path_keys(path, begins, ends)).alias("k")).select("rel_path", "_path", "k.kind", "k.key")
    seen = _stored(seen.join(keyed.select("kind", "key").distinct(), ["kind", "key"], "left_semi"), "seen")
    counts = seen.groupBy("kind", "key").agg(F.count("*").alias("n"))
    # A glob with a key that no path has matches nothing.
    counted = keyed.where("kind <> 'any'").join(counts, ["kind", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("glob", "one").agg(F.min(F.struct("n", "kind", "key")).alias("k"), F.first("regex").alias("regex")).where("k.n > 0").select("k.kind", "k.key", "regex").distinct()
    bad = seen.join(rarest, ["kind", "key"]).where("regex IS NULL OR rlike(_path, regex)").select("rel_path").distinct()
    left = files.join(bad, "rel_path", "left_anti").select(*files.columns)
    return left.where(~path.rlike("|".join(f"(?:{x})" for x in loose))) if loose else left
