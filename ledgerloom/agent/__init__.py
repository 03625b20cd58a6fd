"""Ad-hoc SQL behind a guard, a bounded tool loop and a sandbox; all of it runs on the driver."""
