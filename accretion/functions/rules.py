"""Which paths can be cleaned up, and how safely."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (part of the path in small letters, code, safety); the first that fits counts.
RULES = (
    (r"windows\installer", "winInstaller", "careful"), (r"windows\winsxs", "winSxs", "careful"), (r"windows\softwaredistribution\download", "winUpdate", "safe"), (r"windows\temp", "winTemp", "safe"), (r"$recycle.bin", "recycleBin", "review"),
    (r"appdata\local\temp", "userTemp", "safe"), (r"appdata\local\packages", "storeApps", "review"), (r"appdata\local\microsoft\windows\explorer", "thumbnails", "safe"), (r"appdata\local\pip\cache", "pipCache", "safe"),
    (r"appdata\local\npm-cache", "npmCache", "safe"), (r"appdata\roaming\npm-cache", "npmCache", "safe"), (r"appdata\local\yarn\cache", "yarnCache", "safe"), (r".cache", "toolCache", "safe"), (r".gradle\caches", "gradleCache", "safe"),
    (r".m2\repository", "mavenRepo", "review"), (r".nuget\packages", "nugetCache", "safe"), (r"node_modules", "nodeModules", "review"), (r"__pycache__", "pycache", "safe"), (r"\target\debug", "rustDebug", "safe"), (r"\target\release", "rustRelease", "safe"),
    (r"steamapps\downloading", "steamPartial", "safe"), (r"steamapps\shadercache", "steamShaders", "safe"), (r"steamapps\workshop", "steamWorkshop", "review"), (r"nvidia corporation\downloader", "nvidiaDownload", "safe"), (r"crashdumps", "crashDumps", "safe"),
    (r"windows\minidump", "miniDumps", "safe"), (r"hiberfil.sys", "hiberfil", "careful"), (r"pagefile.sys", "pagefile", "careful"), (r"swapfile.sys", "swapfile", "careful"),
)


def classify(path: Column | str, rules=RULES) -> Column:
    """struct(rule, safety) of the first rule that the path contains, else null."""
    path = F.lower(F.col(path) if isinstance(path, str) else path)
    out = F.lit(None).cast("struct<rule:string,safety:string>")
    for needle, code, safety in reversed(rules):
        out = F.when(F.contains(path, F.lit(needle)), F.struct(F.lit(code).alias("rule"), F.lit(safety).alias("safety"))).otherwise(out)
    return out
