"""panelwright: cross-sectional factor analytics on (code, date) panels, as Spark plans."""
