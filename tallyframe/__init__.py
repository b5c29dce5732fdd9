"""tallyframe: table checking, comparison, protection and upkeep as Spark DataFrame plans."""

__version__ = "0.1.0"
