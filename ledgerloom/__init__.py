"""ledgerloom: document-intelligence analytics expressed as Spark DataFrame plans."""

from ledgerloom.session import checkpointed, local_session
from ledgerloom.tables import table

__all__ = ["checkpointed", "local_session", "table"]
