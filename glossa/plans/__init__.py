"""Plans that need the driver: bounded loops whose rounds are DataFrame jobs."""
