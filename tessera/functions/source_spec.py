"""Where an item comes from, as people write it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame

RAW = "https://raw.githubusercontent.com"


@dataclass(frozen=True)
class Spec:
    root: str
    owner: str | None = None
    repo: str | None = None
    release: bool = False
    tag: str | None = None


def parse(text: str) -> Spec:
    """owner/repo[@ref], URLs of a repository, a branch, a release or raw files, and other HTTPS folders; ValueError for the rest."""
    text = text.strip()
    if m := re.fullmatch(r"([\w-]+)/([\w.-]+?)(?:\.git)?(?:@([\w./-]+))?", text):
        if m[1].lower() not in ("github.com",):
            release = m[3] in ("release", "latest")
            return Spec(f"{RAW}/{m[1]}/{m[2]}/{'HEAD' if release or not m[3] else m[3]}/", m[1], m[2], release)
    url = urlsplit(text if "://" in text else f"https://{text}")
    local = url.scheme == "http" and url.hostname in ("localhost", "127.0.0.1", "::1")
    if not url.hostname or "." not in url.hostname and not local:
        raise ValueError("not an address")
    if url.scheme != "https" and not local:
        raise ValueError("HTTPS is needed")
    parts = [p for p in url.path.split("/") if p]
    query = f"?{url.query}" if url.query else ""
    if url.hostname == "github.com":
        if len(parts) < 2 or not all(re.fullmatch(r"[\w.-]+", p) for p in parts[:2]):
            raise ValueError("not an address")
        owner, repo, rest = parts[0], parts[1].removesuffix(".git"), parts[2:]
        base = f"{RAW}/{owner}/{repo}"
        if rest[:1] == ["releases"]:
            tag = rest[2] if len(rest) > 2 and rest[1] in ("tag", "download") else None
            return Spec(f"{base}/{tag or 'HEAD'}/", owner, repo, True, tag)
        branch = "/".join(rest[1:]) if rest[:1] == ["tree"] else rest[1] if rest[:1] == ["blob"] and len(rest) > 1 else ""
        return Spec(f"{base}/{branch or 'HEAD'}/{query}", owner, repo)
    path = re.sub(r"(?i)/manifest\.json$", "", url.path).rstrip("/") + "/"
    root = f"{url.scheme}://{url.netloc}{path}{query}"
    if url.hostname == "raw.githubusercontent.com" and len(parts) >= 2:
        return Spec(root, parts[0], parts[1])
    return Spec(root)


def parsed(specs: DataFrame) -> DataFrame:
    """(id, text, root, owner, repo, release, tag) of specs (id, text); nulls for a text that is none."""

    def run(frames):
        import pandas as pd

        def one(text):
            try:
                s = parse(text)
                return s.root, s.owner, s.repo, s.release, s.tag
            except (ValueError, AttributeError):
                return (None,) * 5

        for pdf in frames:
            found = pd.DataFrame([one(t) for t in pdf["text"]], columns=["root", "owner", "repo", "release", "tag"], dtype=object)
            yield pd.concat([pdf[["id", "text"]].reset_index(drop=True), found], axis=1)

    return specs.select("id", "text").mapInPandas(run, "id string, text string, root string, owner string, repo string, release boolean, tag string")
