"""Can a score computed on a table be trusted? Profiles, honest splits, paired verdicts and audits on Spark."""
