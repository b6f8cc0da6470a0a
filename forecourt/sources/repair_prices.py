"""The repair price list that ships with the library."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: component, diagnostic, reparation_cost -------------------
REPAIR_PRICES = """\
Brake Pads (Front),squeaking noise when braking,250
Brake Pads (Rear),grinding noise from rear,250
Brake Rotors,steering wheel shakes when braking,450
Brake Caliper,pulling to one side when braking,350
ABS Control Module,ABS light is on,850
Brake Master Cylinder,brake pedal feels spongy,400
Emergency Brake Cable,parking brake not holding,200
Oil Change,routine maintenance due,80
Synthetic Oil Change,routine maintenance synthetic,120
Oil Pan Gasket,oil leak on driveway,450
Valve Cover Gasket,burning oil smell,350
Head Gasket,white smoke from exhaust overheating,2500
Timing Belt,scheduled maintenance ticking noise,900
Timing Chain,rattling noise from engine front,1800
Serpentine Belt,squealing noise on startup,150
Alternator,battery light on dim headlights,550
Starter Motor,car clicks but wont start,450
Battery,car is dead no lights,200
Spark Plugs,engine misfiring rough idle,300
Ignition Coils,check engine light stuttering,600
Fuel Pump,car cranks but wont start,700
Fuel Injector,poor fuel economy gas smell,500
Fuel Filter,hesitation when accelerating,150
Air Filter,dirty engine air filter,50
Radiator,coolant leak overheating,600
Thermostat,engine running cold or hot,250
Water Pump,coolant leak whining noise,550
Coolant Hose,visible leak green fluid,150
Transmission Fluid,transmission slipping,200
Clutch Kit,manual transmission slipping,1200
Transmission Solenoid,stuck in gear check engine light,600
Transmission Rebuild,transmission failure won't move,3500
CV Axle,clicking noise when turning,450
Wheel Bearing,humming noise gets louder with speed,400
Shock Absorbers,bouncy ride clunking over bumps,600
Strut Assembly,rough ride knocking noise,800
Control Arm,clunking noise loose steering,500
Ball Joints,clunking sound uneven tire wear,350
Tie Rod Ends,loose steering wheel,250
Power Steering Pump,whining noise when turning wheel,500
Power Steering Rack,leaking fluid hard to steer,1100
Tire (Economy),worn treads bald tire,120
Tire (Performance),needs new tires,250
Wheel Alignment,car pulls to the left or right,120
Tire Balancing,vibration at highway speeds,80
Bent Rim,vibration thumping sound,200
Muffler,loud exhaust noise,300
Catalytic Converter,check engine light P0420,1500
Exhaust Manifold,loud ticking noise on startup,800
Exhaust Leak,fumes inside cabin,250
Oxygen Sensor,check engine light O2 code,250
MAF Sensor,hesitation stalling,200
Check Engine Light Diag,unknown warning light,150
AC Compressor,ac blowing warm air,900
AC Condenser,ac not working leak found,600
AC Recharge,ac not cold enough,150
Blower Motor,no air coming from vents,300
Heater Core,sweet smell wet floorboard,1000
Window Motor,window stuck wont go up,350
Window Switch,window button not working,150
Door Lock Actuator,door lock stuck,250
Windshield Wipers,streaking on windshield,40
Windshield,cracked windshield stone chip,350
Side Mirror,broken side mirror,300
Headlight Assembly,foggy or broken headlight,250
Tail Light Assembly,cracked tail light,150
Bumper (Front),dent in front bumper,800
Bumper (Rear),rear ended damage,800
Fender,dent in side panel,600
Door Panel,dent in door,500
Hood,hail damage on hood,700
Trunk Lid,trunk wont close properly,400
Paint Touch Up,scratches on paint,200
Full Detail,interior dirty,250
Upholstery Repair,torn seat,300
Headliner,fabric sagging from roof,400
Sunroof Motor,sunroof stuck open,600
Convertible Top,roof leaking or torn,1500
Radio/Head Unit,radio display broken,400
Speakers,sound crackling,200
Backup Camera,camera blue screen,350
Key Fob,remote not working,150
Ignition Switch,key wont turn,300
Battery Terminal,corrosion on battery,50
Fuse,electrical component stopped working,20
Bulb Replacement,light bulb out,30
Wiper Motor,wipers stopped moving,250
Washer Fluid Pump,no water spraying,120
Horn,horn not honking,150
Airbag Sensor,airbag light on,400
Seat Belt,seat belt wont retract,250
Turbocharger,loss of power blue smoke,1800
Diesel Particulate Filter,dpf warning light,2000
AdBlue Heater,def system warning,800
Hybrid Battery,hybrid system warning,2500
EV Charging Port,car wont charge,600
Suspension Air Bag,car sagging on one side,900
Transfer Case,4wd not engaging,1500
Differential,whining noise from rear axle,1200
"""
# --- end of fixed values ----------------------------------------------------


def default_repair_catalog(spark: SparkSession) -> DataFrame:
    """The shipped price list as a table (component, diagnostic, reparation_cost)."""
    lines = spark.createDataFrame([(line,) for line in REPAIR_PRICES.splitlines()], "line string")
    fields = F.from_csv("line", "component string, diagnostic string, reparation_cost int")
    return lines.select(fields.alias("row")).select("row.*")
