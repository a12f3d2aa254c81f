"""Findings of a session: their claims against artifact cells, and numbers in their prose against claims."""

from __future__ import annotations

from dataclasses import dataclass

from ..session import Claim, Finding, Session, new_id
from .claims import CLAIM, check_claims, unbacked_numbers


@dataclass
class ClaimCheck:
    claim: Claim
    ok: bool
    actual: float | None = None
    reason: str = ""


@dataclass
class Verdict:
    verified: bool
    checks: list[ClaimCheck]
    unbacked: list[str]


def add_finding(session: Session, headline: str, claims: list[Claim], detail: str = "") -> Finding:
    f = Finding(new_id("fnd"), headline, detail, claims)
    session.register(f)
    return f


def verify_many(session: Session, findings: list[Finding]) -> list[Verdict]:
    """A verdict for each finding, from the same few jobs for any number of them and one read of each artifact."""
    spark = session.spark
    claims = [(f.finding_id, k, c.artifact_id, c.column, dict(c.where), float(c.value), float(c.rel_tol), float(c.abs_tol)) for f in findings for k, c in enumerate(f.claims)]
    table = spark.createDataFrame(claims, CLAIM)
    known = {c[2]: session.records["artifacts"].get(c[2]) for c in claims}
    artifacts = {rid: session.data(a) if a.data_path is not None else None for rid, a in known.items() if a is not None}
    checks = {(r.finding_id, r.claim): r for r in check_claims(table, artifacts).collect()} if claims else {}
    prose = spark.createDataFrame([(f.finding_id, f"{f.headline}\n{f.detail}") for f in findings], "finding_id string, prose string")
    unbacked: dict[str, list[str]] = {}
    for r in unbacked_numbers(prose, table).orderBy("finding_id", "place").collect():
        unbacked.setdefault(r.finding_id, []).append(r.token)
    out = []
    for f in findings:
        own = [ClaimCheck(c, r.ok, r.actual, r.reason) for k, c in enumerate(f.claims) for r in [checks[f.finding_id, k]]]
        loose = unbacked.get(f.finding_id, [])
        out.append(Verdict(all(c.ok for c in own) and not loose, own, loose))
    return out


def verify(session: Session, finding: Finding) -> Verdict:
    return verify_many(session, [finding])[0]


def verify_and_record(session: Session, finding_id: str) -> Verdict:
    finding = session.finding(finding_id)
    verdict = verify(session, finding)
    finding.status = "verified" if verdict.verified else "refuted"
    session.register(finding)
    return verdict


def verified_findings(session: Session) -> list[Finding]:
    return [f for f in session.findings() if f.status == "verified"]
