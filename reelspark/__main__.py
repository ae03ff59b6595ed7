import sys

from reelspark.plans.directory import main

sys.exit(main())
