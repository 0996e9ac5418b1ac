"""The scan as a plan, its reports, and the synthetic source tree."""
