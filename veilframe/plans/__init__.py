"""What is decided on the driver before a plan exists: budget, parameters, rules, pipelines."""
