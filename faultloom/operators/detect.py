"""Ecosystem of a log from weighted markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultloom.operators.rules import required_literal

STRONG, WEAK, CLAIM = 3, 1, 2

# Markers of each ecosystem, strong ones first, and the order that breaks ties.
MARKERS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "dotnet": (
        (r"(?:error|warning) (?:NU|MSB|CS|NETSDK)\d{3,5}", r"\.csproj", r"\bdotnet (?:build|test|restore|publish|run|pack|tool|format)\b"),
        (r"\bnuget\b", r"\bmsbuild\b", r"\.sln\b"),
    ),
    "node": (
        (
            r"npm ERR!", r"\bERESOLVE\b", r"Cannot find module", r"node_modules", r"package-lock\.json", r"yarn\.lock", r"pnpm-lock\.yaml",
            r"\bnpm (?:install|ci|run|test|publish|exec|audit|pack)\b", r"\byarn (?:install|add|run|test|why|workspaces|dlx)\b", r"\bpnpm (?:install|add|run|test|dlx|exec)\b", r"\bnpx\b",
        ),
        (r"\byarn\b", r"\bpnpm\b", r"\bnpm\b"),
    ),
    "python": (
        (
            r"Traceback \(most recent call last\)", r"ModuleNotFoundError", r"ResolutionImpossible", r"\bpip3? install\b", r"requirements\.txt", r"ERROR: Could not find a version that satisfies", r"\.py\", line \d+",
            r"\bpyproject\.toml\b", r"\bpoetry\.lock\b", r"\bmypy\b", r"\bruff\b", r"\b(?:flake8|pylint|pipenv|virtualenv)\b", r"\b(?:poetry|uv|pipenv|tox) (?:install|lock|add|run|sync|-r|-e)\b",
        ),
        (r"\bpytest\b", r"\bpython3?\b", r"\.py\b"),
    ),
    "java": (
        (r"\bBUILD FAILURE\b", r"\bpom\.xml\b", r"\bjavac\b", r"at org\.junit", r"\bmaven\b", r"\.java:", r"Exception in thread \"[^\"]*\" java\.", r"^BUILD (?:FAILED|SUCCESSFUL) in \d", r"^e: (?:file://)?\S+\.kts?:", r"\.kts?:\d+:\d+"),
        (r"\bkotlin\b", r"\[ERROR\] ", r"\bgradlew\b", r"\bgradle\b", r"\.gradle\b", r"OutOfMemoryError"),
    ),
    "go": (
        (r"\bgo\.mod\b", r"\bgo\.sum\b", r"\bgo (?:build|test|run|get|mod|vet|install)\b", r"cannot find package", r"\bgolang\b", r"\.go:\d+"),
        (r"undefined: ",),
    ),
    "rust": (
        (r"error\[E\d{2,4}\]", r"Cargo\.toml", r"Cargo\.lock", r"\brustc\b", r"\bcargo\b", r"could not compile"),
        (r"--> src/", r"\.rs:\d+"),
    ),
    "ruby": (
        (r"\bGemfile(?:\.lock)?\b", r"\bbundler?\b", r"\brspec\b", r"\.rb:\d+:in ", r"\brake aborted\b", r"\bLoadError\b"),
        (r"\bgem (?:install|not found|\"[^\"]+\")", r"\brake\b"),
    ),
    "php": (
        (r"PHP (?:Fatal|Parse|Warning) error", r"\bPHPUnit\b", r"\bcomposer\b", r"vendor/autoload", r"Fatal error: Uncaught", r"\bpsr-4\b"),
        (r"\.php(?::\d+|\b on line)", r"Call to undefined"),
    ),
    "cpp": (
        (r"undefined reference to", r"CMakeLists\.txt", r"\bcmake\b", r"No rule to make target", r"collect2:", r"fatal error: [^\n]*\.h(?:pp)?: No such file"),
        (r"\.(?:cpp|cc|cxx|hpp)\b", r"\bg\+\+\b", r"\bgcc\b", r"\bclang\b", r"\bld: "),
    ),
    "infra": (
        (
            r"docker build", r"failed to solve", r"\bDockerfile\b", r"\bterraform\b", r"\btofu\b", r"Error acquiring the state lock", r"\bbuildkit\b", r"Step \d+/\d+", r"\bkubectl\b", r"\bkubelet\b", r"\bkubernetes\b",
            r"\bhelm (?:upgrade|install|template|uninstall|rollback|lint|dependency)\b", r"\b(?:CrashLoopBackOff|ImagePullBackOff|ErrImagePull|ErrImageNeverPull)\b",
        ),
        (r"\bhelm\b", r"\bk8s\b", r"\bunauthorized: ", r"^denied: "),
    ),
    "swift": (
        (r"\bswiftc\b", r"\bxcodebuild\b", r"no such module", r"Provisioning profile", r"\.swift:\d+", r"\*\* BUILD FAILED \*\*", r"CompileSwift", r"\bswift (?:build|test|package|run)\b", r"Package\.swift", r"\bPodfile(?:\.lock)?\b", r"\bxcrun\b"),
        (r"\bXcode\b", r"Code Sign(?:ing)?"),
    ),
    "scala": (
        (r"\bbuild\.sbt\b", r"\bsbt (?:compile|test|run|clean|assembly|publish)\b", r"\bproject/build\.properties\b", r"\.scala:\d+", r"\bscalac\b", r"\bScalaTest\b", r"\bcrossScalaVersions\b"),
        (r"\bsbt\b", r"\bscala\b"),
    ),
    "elixir": (
        (r"\bmix\.exs\b", r"\bmix (?:compile|test|deps\.get|deps\.compile|release|format)\b", r"\.exs?:\d+", r"\bmix\.lock\b", r"\*\* \((?:CompileError|SyntaxError|UndefinedFunctionError|Mix\.Error)\)", r"\bExUnit\b"),
        (r"\belixir\b", r"\bhex\b"),
    ),
    "android": (
        (r"\baapt2?\b", r"AndroidManifest", r"com\.android", r"Execution failed for task ':app", r"SDK location", r"Android resource", r"\bdexing\b", r":app:"),
        (r"lint(?:Debug|Release)", r"\bgradlew\b"),
    ),
}
PRECEDENCE = ("android", "swift", "rust", "go", "dotnet", "php", "ruby", "elixir", "python", "node", "scala", "java", "cpp", "infra")


def weighted(ecosystem: str) -> list[tuple[str, int]]:
    strong, weak = MARKERS[ecosystem]
    return [(p, STRONG) for p in strong] + [(p, WEAK) for p in weak]


def scores(text: Column) -> Column:
    """``array<struct<score, precedence, ecosystem>>``: one point sum per ecosystem; a marker
    counts once however often it occurs."""
    low, out = F.lower(text), []

    def hit(pattern: str) -> Column:
        lit = required_literal(pattern, unicode_case=False)
        found = text.rlike("(?dim)" + pattern)
        return F.contains(low, F.lit(lit)) & found if lit else found

    for i, name in enumerate(PRECEDENCE):
        total = sum((F.when(hit(p), w).otherwise(0) for p, w in weighted(name)), F.lit(0))
        out.append(F.struct(total.cast("int").alias("score"), F.lit(-i).alias("precedence"), F.lit(name).alias("ecosystem")))
    return F.array(*out)


def best(text: Column) -> Column:
    """``struct<score, precedence, ecosystem>`` of the highest score, earlier ecosystems first."""
    return F.array_max(scores(text))


def claimed(best: Column) -> Column:
    """The best ecosystem if it has at least two points, else generic."""
    return F.when(best["score"] >= CLAIM, best["ecosystem"]).otherwise("generic")


def ecosystem(text: Column) -> Column:
    return F.element_at(F.transform(F.array(best(text)), claimed), 1)


def detail(text: Column, shown: int = 4) -> Column:
    """The best-scoring ecosystems above zero."""
    return F.slice(F.reverse(F.array_sort(F.filter(scores(text), lambda s: s["score"] > 0))), 1, shown)
