"""Evidence analytics on Spark: canonical elements, lexical search, facts, versions, conditions, reviews, audits."""
