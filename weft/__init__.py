"""A cache-aware pipeline engine for Spark: tasks, profiles, fingerprints, task state, mapped execution, lineage, previews."""
