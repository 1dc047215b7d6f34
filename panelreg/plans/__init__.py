"""The three jobs: linear baseline, random forest, boosting."""
