"""The corpus pipeline; its stages live in the subpackage for training data."""
from pressweave.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
