"""Reports for people: charts, simulation reports, accuracy reports."""
