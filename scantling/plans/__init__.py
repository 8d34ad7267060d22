"""Query catalogue: each plan beside the SQL that states it."""
