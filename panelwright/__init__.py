"""panelwright: survey-microdata preparation and feature-ranking jobs on Spark."""
