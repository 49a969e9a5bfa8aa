"""Domain plans: effort, scenarios, risk, trade-offs, logbooks, covariates."""
