"""Further queries with their SQL, by subject; importing them adds them to the catalog."""

from witnesslake.queries import demands, documents, evaluation, evaluator, evidence, exposure, ledger, perception, platform, registry, tracking

__all__ = ["demands", "documents", "evaluation", "evaluator", "evidence", "exposure", "ledger", "perception", "platform", "registry", "tracking"]
