"""Limits, defaults and fixed values of searches and jobs."""

from __future__ import annotations

from dataclasses import dataclass

# Paths that no search shows.
EXCLUDES = (
    "**/.git/**",
    "**/.svn/**",
    "**/.hg/**",
    "**/node_modules/**",
    "**/.pnpm-store/**",
    "**/bower_components/**",
    "**/venv/**",
    "**/.venv/**",
    "**/__pycache__/**",
    "**/.tox/**",
    "**/.nox/**",
    "**/.pytest_cache/**",
    "**/.mypy_cache/**",
    "**/.ruff_cache/**",
    "**/target/**",
    "**/dist/**",
    "**/build/**",
    "**/out/**",
    "**/.next/**",
    "**/.nuxt/**",
    "**/coverage/**",
    "**/.cache/**",
    "**/.cargo/registry/**",
    "**/.cargo/git/**",
    "**/.rustup/**",
    "**/go/pkg/mod/**",
    "**/.local/share/Trash/**",
    "**/diag-live/**",
    "**/.ssh/**",
    "**/.gnupg/**",
    "**/.aws/credentials",
    "**/.netrc",
    "**/id_rsa",
    "**/id_ed25519",
    "**/*.pem",
    "**/*.key",
    "**/shadow",
    "**/gshadow",
    "proc/**",
    "sys/**",
    "dev/**",
    "run/**",
    "**/proc/**",
    "**/sys/**",
    "**/dev/**",
    "**/run/**",
)


def all_excludes(user=(), job_folder: str | None = None) -> tuple[str, ...]:
    """The fixed excludes, the folder where job results are kept, and the user's own, each once."""
    jobs = (f"**/{job_folder}/**",) if job_folder else ()
    return tuple(dict.fromkeys((*EXCLUDES, *jobs, *user)))


# Budgets and intervals, in bytes, rows and milliseconds.
@dataclass(frozen=True)
class Limits:
    max_results: int = 64
    context_lines: int = 2
    response_bytes: int = 131_072
    overall_timeout_ms: int = 5_000
    max_file_bytes: int = 16_777_216
    job_timeout_ms: int = 600_000
    job_ttl_ms: int = 1_800_000
    max_jobs: int = 256
    job_store_bytes: int = 67_108_864
    page_size: int = 32
    max_page_size: int = 64
    preview_lines: int = 200
    preview_bytes: int = 65_536
    registry_ttl_ms: int = 30_000
    registry_grace_ms: int = 300_000
    replay_window_ms: int = 60_000
    backup_stale_after_ms: int = 86_400_000


LIMITS = Limits()
